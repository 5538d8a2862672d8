from collections import defaultdict

import pytest
from helpers import awkward, none_of
from pyspark.sql import functions as F

from wardlight.llm import mixing
from wardlight.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, stopped, total = {}, set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in stopped)
        share = sum(weight[s] for s in order if s not in stopped)
        target = {s: 2.0 * sizes[s] if s in stopped else left * weight[s] / share for s in order}
        above = {s for s in order if s not in stopped and target[s] > 2 * sizes[s]}
        if not above:
            return target
        stopped |= above


def brute_seats(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = min(weights, key=lambda k: (-weights[k] / (2 * got[k] + 1), k))
        got[best] += 1
    return got


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 351])
def test_apportion_by_highest_quotient(spark, seats):
    weights = {i: w for i, w in enumerate([53.0, 24.0, 23.0, 0.2, 0.2, 0.4, 11.0, 11.0, 0.0, 900.5])}
    claims = spark.createDataFrame([("g", k, w, seats) for k, w in weights.items()] + [("h", 1, 0.0, 5)], "g string, k long, w double, seats long")
    got = {r["k"]: r["quota"] for r in mixing.apportion(claims, ["g"], "k", "w", "seats").filter("g = 'g'").collect()}
    assert got == brute_seats(weights, seats)


def check(rows):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 2 * mixing.BLOCK


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs, Scratch(spark, "t")).collect()
    assert len(rows) == docs.count()
    check(rows)
    again = mixing.mix(docs.repartition(3), Scratch(spark, "t")).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_many_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = mixing.mix(docs, Scratch(spark, "t"), shard_words=2000).collect()
    assert len({r["shard"] for r in rows if r["source"] == "hot"}) > 5
    check(rows)


def test_awkward(spark):
    rows = mixing.mix(awkward(spark), Scratch(spark, "t")).collect()
    assert len(rows) == awkward(spark).count()
    check(rows)
    assert mixing.mix(none_of(spark), Scratch(spark, "t")).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(blank, Scratch(spark, "t")).collect()] == [(0, 0.0, 0)] * 2
