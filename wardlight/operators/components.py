"""What declared components take part in: scopes, participation, composition, risk evidence.

``context`` rows: (target keys), component, component_id, component_type, source, target,
edge_type, assoc_source. An association names an existing edge of an existing graph
component (``component``) and an existing declared component; nothing is inferred. Joins
hold within the target and the component, so what merely shares names never meets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.operators.graph import kind_of
from wardlight.operators.paths import path_edges
from wardlight.operators.targets import by_target

OWNER = ["component_id", "component_type"]
EDGE = ["component", "source", "target", "edge_type"]


def behaviour() -> Column:
    return F.struct("source", "edge_type", "target")


@by_target()
def context_violations(context: DataFrame, nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Associations that name no real component or edge: (keys, kind, subject)."""
    said = F.concat_ws(" ", "component_id", "component_type", "source", "edge_type", "target").alias("subject")

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.select(*keys, F.lit(kind).alias("kind"), said)

    bad_type = rows(context.where(~F.col("component_type").isin(vocab.COMPONENT_TYPES)), "component_type")
    bad_edge_type = rows(context.where(~F.col("edge_type").isin(vocab.BEHAVIOUR_TYPES)), "edge_type")
    known = nodes.select(*keys, F.col("id").alias("component_id"), F.col("type").alias("real_type")).distinct()
    joined = context.join(known, [*keys, "component_id"], "left")
    absent = rows(joined.where("real_type IS NULL"), "unknown_component")
    mismatch = rows(joined.where("real_type IS NOT NULL AND real_type <> component_type"), "type_mismatch")
    real = edges.select(*keys, "component", "source", "target", F.col("type").alias("edge_type")).distinct()
    no_edge = rows(context.join(real, [*keys, *EDGE], "left_anti"), "unknown_edge")
    return bad_type.unionByName(bad_edge_type).unionByName(absent).unionByName(mismatch).unionByName(no_edge).distinct()


@by_target()
def valid_context(context: DataFrame, nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Associations that hold, each once per (edge, component, source)."""
    known = nodes.select(*keys, F.col("id").alias("component_id"), F.col("type").alias("component_type")).distinct()
    real = edges.select(*keys, "component", "source", "target", F.col("type").alias("edge_type")).distinct()
    return (
        context.where(F.col("component_type").isin(vocab.COMPONENT_TYPES) & F.col("edge_type").isin(vocab.BEHAVIOUR_TYPES))
        .join(known, [*keys, *OWNER], "left_semi")
        .join(real, [*keys, *EDGE], "left_semi")
        .distinct()
    )


def security_scope(context: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Behaviours per component, one row each. Ordered by type, id and behaviour on output."""
    return context.select(*keys, *OWNER, "source", "edge_type", "target").distinct()


@by_target()
def participation(paths: DataFrame, context: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Behaviours of components that lie on a path, walked or associated: one row each.

    A composed path crosses components by hand-offs, which are no behaviour; every other
    path lies in one component, so the component is part of the key.
    """
    on = path_edges(paths, keys, "component").select(*keys, "path_id", "component", "source", "target", F.col("type").alias("edge_type")).distinct()
    owned = context.select(*keys, *OWNER, *EDGE).distinct()
    return on.join(owned, [*keys, *EDGE]).select(*keys, "path_id", *OWNER, "source", "edge_type", "target")


def composition(paths: DataFrame, context: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Components of a path, one row each: their first behaviour, how many, and their place in the path."""
    rows = participation(paths, context, keys).groupBy(*keys, "path_id", *OWNER).agg(F.min(behaviour()).alias("first"), F.count("*").alias("behaviours"))
    order = W.partitionBy(*keys, "path_id").orderBy("first", "component_type", "component_id")
    return rows.withColumn("place", F.row_number().over(order))


def _label(edge_type: Column, target: Column) -> Column:
    kind = kind_of(target)
    return (
        F.when((edge_type == "READS") & (kind == "SECRET"), F.lit("secret read"))
        .when((edge_type == "READS") & (kind == "DATA"), F.lit("sensitive data read"))
        .when(edge_type == "FLOWS_TO", F.lit("sensitive data flow"))
        .when(edge_type == "SENDS_TO", F.lit("external network send"))
        .when(edge_type == "EXECUTES", F.lit("execution"))
    )


@by_target()
def risk_evidence(paths: DataFrame, context: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per path and component: relevant behaviours, the facts they back, and the risk of the path."""
    rows = participation(paths, context, keys).withColumn("label", _label(F.col("edge_type"), F.col("target"))).where("label IS NOT NULL")
    mine = rows.groupBy(*keys, "path_id", *OWNER).agg(
        F.collect_set("label").alias("labels"), F.count("*").alias("behaviours"), F.min(behaviour()).alias("first")
    )
    order = F.array(*[F.lit(x) for x in vocab.EVIDENCE_ORDER])
    facts = paths.select(*keys, "path_id", "evidence", "risk_severity", "risk_confidence")
    return mine.join(facts, [*keys, "path_id"]).select(
        *keys, "path_id", *OWNER, "behaviours",
        F.array_intersect(F.array_intersect(order, F.col("labels")), F.col("evidence")).alias("evidence"),
        "risk_severity", "risk_confidence",
    )
