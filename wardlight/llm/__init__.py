"""Operators for pipelines that prepare training text. Nothing else in the library imports them."""
