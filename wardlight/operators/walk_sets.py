"""All walks of a graph without listing them: exact counts and the shortest walks per end.

A walk set is the graph itself, cut to the nodes from which an end can be reached. Nodes are folded
from the ends backwards: a node is done when all its successors are, and then knows how many walks
lead on from it (sums over edges) and the ``k`` shortest of them (merged lists). That takes as many
rounds as the longest walk has edges, and rows as many as there are edges, however many walks there
are. On a cycle nodes wait for each other, and simple walks have no such sum; a component
that holds a cycle among its useful nodes is listed instead, and only that one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.operators import paths as pt
from wardlight.operators.graph import kind_of
from wardlight.operators.targets import by_target
from wardlight.session import cut

COUNT = "decimal(38,0)"
SUFFIX = "array<struct<n:int,nodes:array<string>,sev:int,conf:int>>"


def _shortest(lists: Column, k: int) -> Column:
    """The ``k`` first of collected lists of walks, fewer nodes first, then by name."""
    return F.slice(F.array_sort(F.flatten(lists)), 1, k)


def _folded(steps: DataFrame, ends: DataFrame, place: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """Per node the walks that lead on from it, and the places that hold a cycle.

    ``steps``: place, source, target, sev, conf, with every target able to reach an end. ``ends``: place, node,
    proven, other (walks that end here), best (the shortest of them). Returns (place, node, proven, other, best).
    """
    at = [*place, "node"]
    sources = steps.groupBy(*place, F.col("source").alias("node")).agg(F.count("*").alias("open"))
    zero, none = F.lit(0).cast(COUNT), F.array().cast(SUFFIX)
    state = sources.join(ends, at, "full_outer").select(
        *at, F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("proven", zero).alias("proven"), F.coalesce("other", zero).alias("other"), F.coalesce("best", none).alias("best")
    )
    state = cut(state)
    done = None
    while True:
        ready = cut(state.where("open = 0").drop("open"))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        longer = F.transform(
            "best", lambda w: F.struct((w["n"] + 1).alias("n"), F.concat(F.array("source"), w["nodes"]).alias("nodes"), F.greatest(w["sev"], F.col("sev")).alias("sev"), F.greatest(w["conf"], F.col("conf")).alias("conf"))
        )
        heard = steps.join(ready.withColumnRenamed("node", "target"), [*place, "target"]).select(*place, "source", "proven", "other", longer.alias("best"))
        heard = heard.groupBy(*place, F.col("source").alias("node")).agg(F.count("*").alias("n"), F.sum("proven").cast(COUNT).alias("p"), F.sum("other").cast(COUNT).alias("o"), _shortest(F.collect_list("best"), k).alias("b"))
        waiting = state.where("open > 0").join(heard, at, "left")
        state = cut(
            waiting.select(
                *at, (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), (F.col("proven") + F.coalesce("p", zero)).cast(COUNT).alias("proven"),
                (F.col("other") + F.coalesce("o", zero)).cast(COUNT).alias("other"), F.when(F.col("b").isNull(), F.col("best")).otherwise(_shortest(F.array("best", "b"), k)).alias("best"),
            )
        )
    cyclic = cut(state.select(*place).distinct())
    return (state.drop("open") if done is None else done), cyclic


def _exfiltration_ends(sends: DataFrame, place: Sequence[str], k: int) -> DataFrame:
    walk = F.struct(F.lit(2).alias("n"), F.array("source", "target").alias("nodes"), F.col("sev").cast("int").alias("sev"), F.col("conf").cast("int").alias("conf"))
    outside = kind_of(F.col("target")) == "ENDPOINT"
    best = F.min_by(walk, walk) if k == 1 else F.slice(F.array_sort(F.collect_list(walk)), 1, k)
    return sends.groupBy(*place, F.col("source").alias("node")).agg(F.count_if(outside).cast(COUNT).alias("proven"), F.count_if(~outside).cast(COUNT).alias("other"), (F.array(best) if k == 1 else best).cast(SUFFIX).alias("best"))


def _exfiltration_sets(ranked: DataFrame, keys: Sequence[str], k: int):
    place = [*keys, "component"]
    reads, flows, sends = pt.read_origins(ranked), pt._of_type(ranked, "FLOWS_TO"), pt._of_type(ranked, "SENDS_TO")
    useful = pt._can_reach(flows, sends.select(*place, F.col("source").alias("node")), keys)
    reached = pt.reached(flows, reads.select(*place, F.col("target").alias("node")), keys)
    steps = flows.join(useful.withColumnRenamed("node", "target"), [*place, "target"], "left_semi").join(reached.withColumnRenamed("node", "source"), [*place, "source"], "left_semi")
    steps = cut(steps.where("source <> target").select(*place, "source", "target", "sev", "conf"))
    folded, cyclic = _folded(steps, _exfiltration_ends(sends, place, k), place, k)
    return reads, folded, cyclic


@by_target()
def walk_counts(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, attack_type, walks): how many paths of each type ``paths.analyze`` would list, summed over components.

    A path that two components hold is one for each of them. Where a skill reads and executes, the pairs are
    counted as a product. Counts beyond the largest decimal of 38 digits fail the job rather than wrap.
    """
    place = [*keys, "component"]
    ranked = cut(pt.ranked_edges(edges, keys))
    reads, folded, cyclic = _exfiltration_sets(ranked, keys, 1)
    straight = reads.join(cyclic, place, "left_anti").join(folded.withColumnRenamed("node", "target"), [*place, "target"])
    kind = F.when(kind_of(F.col("target")) == "SECRET", F.lit("SECRET_EXFILTRATION")).otherwise(F.lit("DATA_EXFILTRATION"))
    parts = [
        straight.select(*keys, kind.alias("attack_type"), F.col("proven").alias("walks")),
        straight.select(*keys, F.lit("UNKNOWN").alias("attack_type"), F.col("other").alias("walks")),
    ]
    if not cyclic.isEmpty():
        listed = pt.finalize(pt._exfiltration(cut(ranked.join(cyclic, place, "left_semi")), None, keys).select(*keys, *pt.PATH_COLUMNS), keys)
        parts.append(listed.groupBy(*keys, "attack_type").agg(F.count("*").cast(COUNT).alias("walks")))
    secrets = reads.where(kind_of(F.col("target")) == "SECRET").groupBy(*place, "source").agg(F.count("*").alias("secrets"))
    runs = pt._of_type(ranked, "EXECUTES").groupBy(*place, "source", (kind_of(F.col("target")) == "ACTION").alias("acts")).agg(F.count("*").alias("actions"))
    both = secrets.join(runs, [*place, "source"])
    parts.append(both.select(*keys, F.when(F.col("acts"), F.lit("CORRELATED_SECRET_EXECUTION")).otherwise(F.lit("UNKNOWN")).alias("attack_type"), (F.col("secrets") * F.col("actions")).cast(COUNT).alias("walks")))
    parts.append(_handoff_counts(ranked, keys))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.groupBy(*keys, "attack_type").agg(F.sum("walks").cast(COUNT).alias("walks")).where("walks > 0")


def _handoff_counts(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal hand-off walks from every head; a target whose hand-offs run in a circle is listed."""
    hand = cut(pt._of_type(ranked, "HANDOFF").groupBy(*keys, "source", "target").agg(F.max("sev").alias("sev"), F.max("conf").alias("conf")))
    if not keys:  # the walks are those of one merged graph
        hand, keys_in = hand.withColumn("_all", F.lit(0)), ["_all"]
    else:
        keys_in = list(keys)
    last = hand.select(*keys_in, F.col("target").alias("node")).distinct().join(hand.select(*keys_in, F.col("source").alias("node")).distinct(), [*keys_in, "node"], "left_anti")
    one = F.array(F.struct(F.lit(1).alias("n"), F.array("node").alias("nodes"), F.lit(None).cast("int").alias("sev"), F.lit(None).cast("int").alias("conf")))
    ends = last.select(*keys_in, "node", F.lit(0).cast(COUNT).alias("proven"), F.lit(1).cast(COUNT).alias("other"), one.cast(SUFFIX).alias("best"))
    folded, cyclic = _folded(hand, ends, keys_in, 1)
    heads = pt.handoff_heads(hand.withColumn("type", F.lit("HANDOFF")), keys_in).withColumnRenamed("source", "node")
    straight = heads.join(cyclic, keys_in, "left_anti").join(folded, [*keys_in, "node"]).select(*keys, F.lit("UNKNOWN").alias("attack_type"), F.col("other").alias("walks"))
    if cyclic.isEmpty():
        return straight
    listed = pt._handoffs(hand.join(cyclic, keys_in, "left_semi").withColumn("type", F.lit("HANDOFF")), keys_in)
    return straight.unionByName(listed.select(*keys, F.lit("UNKNOWN").alias("attack_type"), F.lit(1).cast(COUNT).alias("walks")))


@by_target()
def shortest_walks(edges: DataFrame, keys: Sequence[str] = (), k: int = 10) -> DataFrame:
    """The ``k`` shortest exfiltration paths of every component (ties by node names), as ``paths.analyze`` lists them."""
    place = [*keys, "component"]
    ranked = cut(pt.ranked_edges(edges.where("type IN ('READS', 'FLOWS_TO', 'SENDS_TO')"), keys))
    reads, folded, cyclic = _exfiltration_sets(ranked, keys, k)
    joined = reads.join(cyclic, place, "left_anti").join(folded.withColumnRenamed("node", "target"), [*place, "target"])
    walk = F.transform("best", lambda w: F.struct((w["n"] + 1).alias("n"), F.concat(F.array("source"), w["nodes"]).alias("nodes"), F.greatest(w["sev"], F.col("sev"), F.lit(pt.MEDIUM)).alias("sev"), F.greatest(w["conf"], F.col("conf"), F.lit(pt.MEDIUM_CONF)).alias("conf")))
    few = joined.select(*place, walk.alias("walks")).groupBy(*place).agg(_shortest(F.collect_list("walks"), k).alias("walks")).select(*place, F.inline("walks"))
    origin = F.get("nodes", F.lit(1))
    kind = F.when(kind_of(origin) == "SECRET", F.lit("exposure")).when(F.size("nodes") > 3, F.lit("sensitive-data")).otherwise(F.lit("data"))
    rows = few.select(*place, "nodes", pt._walk_edges(F.col("nodes")).alias("edges"), pt._no_edges().alias("associated_edges"), "sev", "conf", kind.alias("kind"))
    if not cyclic.isEmpty():
        listed = pt._exfiltration(cut(ranked.join(cyclic, place, "left_semi")), None, keys).select(*place, "nodes", "edges", "associated_edges", "sev", "conf", "kind")
        first = F.slice(F.array_sort(F.collect_list(F.struct(F.size("nodes").alias("n"), "nodes", "edges", "associated_edges", "sev", "conf", "kind"))), 1, k)
        rows = rows.unionByName(listed.groupBy(*place).agg(first.alias("walks")).select(*place, F.inline("walks")).drop("n"))
    return pt.finalize(rows.select(*keys, *pt.PATH_COLUMNS), keys)


def worst_type(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, paths, proven_paths, worst_attack, worst_path_score) of walk counts; counts stop at the largest long."""
    score = F.create_map(*[F.lit(x) for kind, (_, _, points) in vocab.RISK.items() for x in (kind, points)])[F.col("attack_type")]
    most = F.lit(2**63 - 1).cast(COUNT)
    total = lambda column: F.least(F.sum(column), most).cast("long")
    return counts.withColumn("points", score.cast("int")).groupBy(*keys).agg(
        total(F.col("walks")).alias("paths"), total(F.when(F.col("attack_type") != "UNKNOWN", F.col("walks")).otherwise(F.lit(0).cast(COUNT))).alias("proven_paths"),
        F.max_by("attack_type", "points").alias("worst_attack"), F.max("points").alias("worst_path_score"),
    )
