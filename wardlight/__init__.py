"""Spark-native analytics over corpora of agent components."""
