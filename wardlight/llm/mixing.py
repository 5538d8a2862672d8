"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets: the weighted shares of ``share`` times all words, each stopped at ``cap`` times its
source's words, the excess reshared by weight. Stopping is a water level: with the sources in
order of cap/weight, the level is the largest of (what is left) / (weight that is left).
The mix is dealt in blocks of ``block`` words. Blocks go to sources, then to the shards of a
source, by highest quotient weight / (2 seats + 1). Two divisors bracket the result, so that of
n claimants with T seats at most 2 n quotients are ranked, however large T is. A shard lays its
documents out in seeded order; its quota is whole rounds over the shard plus the first blocks
of that order, which makes every document's share plain arithmetic: no block becomes a row.

Defined results: null text has size 0 and takes 0. Null source is a source, last in order.
Null ids share the order of the empty text; repeated rows are rows of their own. An empty table
gives an empty result. ``cap`` has to be an integer. A quota stops at ``cap`` times its shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import WORD, Scratch, table

BLOCK = 16
SHARD_WORDS = 1 << 18
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, share: float, cap: int, weights: tuple[float, ...]) -> DataFrame:
    """(source, words) -> (src, source, words, target); one row per source, so plain windows do."""
    order, everything = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    numbered = sources.withColumn("src", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("most", F.col("words") * F.lit(float(cap)))
    before = W.orderBy(F.col("most") / F.col("weight"), "src").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("words").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return numbered.withColumn("level", level).withColumn("level", F.max("level").over(everything)).select(
        "src", "source", "words", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target")
    )


def apportion(claims: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Sainte-Lague seats of each (group, key) as column ``quota``; ``seats`` is constant in a group.

    With n claimants of total weight w, the divisors w / (seats - n/2) and w / (seats + n/2) give
    at most and at least ``seats`` seats; the result lies between the two, claimant by claimant.
    """
    whole = W.partitionBy(*group)
    claims = claims.withColumn("w_all", F.sum(weight).over(whole)).withColumn("n_all", F.count(F.lit(1)).over(whole))

    def seats_at(total: Column) -> Column:
        return F.when((total <= 0) | (F.col("w_all") <= 0), F.lit(0)).otherwise(F.floor(F.col(weight) * total / F.col("w_all") + 0.5)).cast("long")

    claims = claims.withColumn("low", seats_at(F.col(seats) - F.col("n_all") / 2)).withColumn("high", seats_at(F.col(seats) + F.col("n_all") / 2 + 1))
    open_seats = claims.withColumn("open", F.col(seats) - F.sum("low").over(whole))
    ranked = open_seats.withColumn("seat", F.explode_outer(F.expr("case when high > low then sequence(low, high - 1) end")))
    quotient = F.col(weight) / (2 * F.col("seat") + 1)
    rank = F.row_number().over(whole.orderBy(quotient.desc_nulls_last(), F.col(key)))
    won = (F.col("seat").isNotNull() & (F.col("rank") <= F.col("open"))).cast("long")
    return ranked.withColumn("rank", rank).groupBy(*group, key).agg((F.max("low") + F.sum(won)).alias("quota"))


def mix(
    docs: DataFrame, scratch: Scratch, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5, cap: int = 2, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 20,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken."""
    sized = scratch.write(docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size")), "sized")
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("words")), share, cap, weights)
    seats = wanted.withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")).withColumn("one", F.lit(1))
    won = apportion(seats, ["one"], "src", "target", "seats").withColumnRenamed("quota", "blocks").drop("one")
    sources = scratch.write(wanted.join(won, "src").withColumn("shards", F.greatest(F.ceil(F.col("words") / shard_words), F.lit(1))), "sources")
    places = sources.select("src", F.col("source").alias("its_source"), "words", "target", "blocks", "shards")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    dealt = sized.join(places, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), ident), F.col("shards"))).withColumn("turn", F.xxhash64(F.lit(seed + 1), ident))
    shards = dealt.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.max("blocks").alias("seats"))
    quotas = apportion(shards, ["src"], "shard", "shard_size", "seats").join(shards.drop("seats"), ["src", "shard"])
    tokens = F.least(F.col("quota") * block, F.col("shard_size") * cap)
    quotas = quotas.withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(tokens / F.col("shard_size"))).otherwise(F.lit(0)).cast("long"))
    quotas = quotas.withColumn("rest", tokens - F.col("rounds") * F.col("shard_size")).select("src", "shard", "rounds", "rest")
    order = W.partitionBy("src", "shard").orderBy("turn", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    laid = dealt.withColumn("upto", F.sum("size").over(order)).join(scratch.write(quotas, "quotas"), ["src", "shard"])
    part = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("rest")) - (F.col("upto") - F.col("size")))
    return laid.select(
        "doc_id", "size", F.col("words").alias("source_size"), "target", (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"), "source",
        "shard",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), Scratch(spark, "mix"))
