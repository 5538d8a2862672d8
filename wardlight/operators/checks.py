"""Checks on finished paths and policy results. Each check yields violation rows.

``keys`` are the columns of one target: a path is checked against the graph of its own target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators.graph import kind_of
from wardlight.operators.paths import asset_index, is_contiguous, path_edges, path_id
from wardlight.operators.targets import by_target

SHAPE = ["kind", "subject", "detail"]


def _subject() -> Column:
    return F.coalesce(F.nullif("path_id", F.lit("")), F.lit("<no path_id>"))


def _rows(df: DataFrame, kind: str, detail: Column | str, subject: Column | None = None) -> DataFrame:
    words = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(kind).alias("kind"), (_subject() if subject is None else subject).alias("subject"), words.alias("detail"))


def _violation(when: Column, kind: str, detail: Column | str) -> Column:
    """One violation of a row, or null."""
    words = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(when, F.struct(F.lit(kind).alias("kind"), words.alias("detail")))


def _found(rows: DataFrame, *violations: Column) -> DataFrame:
    """All violations of each path, in one pass over the paths.

    They are sifted as generated rows: a filter in front would be pushed down, and carry all that paths are computed of.
    """
    return rows.select(_subject().alias("subject"), F.inline_outer(F.array(*violations))).where("kind IS NOT NULL").select(*SHAPE)


def _identity() -> list[Column]:
    own = path_id(F.col("nodes"), F.col("edges"), F.col("associated_edges"))
    missing = F.coalesce(F.col("path_id"), F.lit("")) == ""
    return [
        _violation(missing, "missing_path_id", "the path has no identity"),
        _violation(~missing & (F.col("path_id") != own), "path_id_mismatch", "the identity is not that of the walk"),
    ]


def path_identity(paths: DataFrame) -> DataFrame:
    """No id, or an id that is not the one of this walk."""
    return _found(paths, *_identity())


def _broken() -> list[Column]:
    return [_violation(~is_contiguous(F.col("nodes"), F.col("edges")), "non_contiguous_walk", "the edges are no walk over the nodes")]


def contiguity(paths: DataFrame) -> DataFrame:
    return _found(paths, *_broken())


@by_target()
def phantom_nodes(paths: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    named = paths.select(*keys, "path_id", F.explode("nodes").alias("id"))
    return _rows(named.join(nodes.select(*keys, "id").distinct(), [*keys, "id"], "left_anti"), "phantom_node", F.concat(F.lit("node "), "id", F.lit(" is not in the graph")))


@by_target()
def phantom_edges(paths: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    real = edges.select(*keys, "source", "target", "type").distinct()
    unknown = path_edges(paths, keys).join(real, [*keys, "source", "target", "type"], "left_anti")
    said = F.concat(F.lit("edge "), "source", F.lit(" -"), "type", F.lit("-> "), "target", F.lit(" is not in the graph"))
    return _rows(unknown, "phantom_edge", said)


def _above() -> list[Column]:
    top_severity = tx.map_lookup(F.col("attack_type"), {k: vocab.SEVERITY_RANK[v[0]] for k, v in vocab.RISK.items()}, 0)
    top_confidence = tx.map_lookup(F.col("attack_type"), {k: vocab.CONFIDENCE_RANK[v[1]] for k, v in vocab.RISK.items()}, 0)

    def above(column: str, rank, top: Column, kind: str) -> Column:
        too_much = F.coalesce(rank(F.col(column)), F.lit(0)) > top
        return _violation(too_much, kind, F.concat(F.lit(f"{column} "), F.col(column), F.lit(" is more than "), "attack_type", F.lit(" proves")))

    return [
        above("severity", tx.severity_rank, top_severity, "unproven_severity"),
        above("confidence", tx.confidence_rank, top_confidence, "unproven_confidence"),
        above("risk_severity", tx.severity_rank, top_severity, "risk_above_ceiling"),
    ]


def ceiling(paths: DataFrame) -> DataFrame:
    """Declared strength above what the attack type can prove."""
    return _found(paths, *_above())


def _bare() -> list[Column]:
    bare = (F.coalesce(tx.severity_rank(F.col("risk_severity")), F.lit(0)) > 0) & (F.size("evidence") == 0)
    return [_violation(bare, "severity_without_evidence", F.concat(F.lit("risk_severity "), "risk_severity", F.lit(" without evidence")))]


def severity_without_evidence(paths: DataFrame) -> DataFrame:
    return _found(paths, *_bare())


@by_target()
def policy_results(paths: DataFrame, results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """No id, orphan, duplicate, violation without proof or without reason.

    Results meet their paths once; what is wrong is counted per policy and path, and a count becomes as many rows.
    """
    has_id = F.coalesce(F.col("path_id"), F.lit("")) != ""
    own = [*keys, "path_id"]
    known = paths.where(has_id).groupBy(*own).agg(F.min("attack_type").alias("attack_type"), F.lit(True).alias("met"))
    blank = F.trim(F.coalesce("reason", F.lit(""))) == ""
    counted = results.where(has_id).select(*own, "policy_id", "violated", blank.alias("blank")).join(known, own, "left").groupBy(*own, "policy_id").agg(
        F.count_if(F.col("met").isNull()).alias("orphans"), F.count_if("met").alias("matched"),
        F.count_if(F.expr("met AND violated AND attack_type = 'UNKNOWN'")).alias("unproven"), F.count_if(F.expr("met AND violated AND blank")).alias("unsaid"),
    )

    def times(n: Column, kind: str, detail: str) -> Column:
        return F.array_repeat(F.struct(F.lit(kind).alias("kind"), F.lit(detail).alias("detail")), n.cast("int"))

    wrong = F.concat(
        times(F.col("orphans"), "orphan_policy_result", "the path was not evaluated"),
        times(F.greatest(F.col("matched") - 1, F.lit(0)), "duplicate_policy_result", "the pair was evaluated again"),  # every repetition beyond the first
        times(F.col("unproven"), "violation_without_proof", "violated on a path without proven semantics"),
        times(F.col("unsaid"), "violation_without_reason", "violated with an empty reason"),
    )
    subject = F.concat("policy_id", F.lit("@"), _subject())
    counted = counted.where("orphans > 0 OR matched > 1 OR unproven > 0 OR unsaid > 0").select(subject.alias("subject"), F.inline(wrong)).select(*SHAPE)
    return _rows(results.where(~has_id), "result_without_path_id", "the result names no path", subject).unionByName(counted)


@by_target()
def all_checks(paths: DataFrame, results: DataFrame, edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every violation; a sound run yields no row."""
    rows = _found(paths, *_identity(), *_broken(), *_above(), *_bare())
    for more in (phantom_nodes(paths, nodes, keys), phantom_edges(paths, edges, keys), policy_results(paths, results, keys)):
        rows = rows.unionByName(more)
    return rows


def assert_sound(violations: DataFrame, shown: int = 20) -> None:
    """Stop a job whose paths claim more than they prove."""
    rows = violations.orderBy(*SHAPE).limit(shown).collect()
    if rows:
        raise AssertionError("\n".join(f"[{r.kind}] {r.subject}: {r.detail}" for r in rows))


def proof_checks(paths: DataFrame) -> DataFrame:
    """Clause by clause: does the stored walk prove its attack type? One row per clause."""
    nodes, edges, assoc = F.col("nodes"), F.col("edges"), F.col("associated_edges")
    last = tx.last(edges)
    at = F.col("_asset")
    tail = F.slice(edges, F.greatest(at, F.lit(0)) + 1, F.greatest(F.size(edges) - 1 - at, F.lit(0)))
    wanted = F.when(F.col("attack_type") == "SECRET_EXFILTRATION", F.lit("SECRET")).otherwise(F.lit("DATA"))
    sends = last["type"] == "SENDS_TO"
    reads = F.exists(assoc, lambda e: (e["type"] == "READS") & (e["source"] == F.get(nodes, F.lit(0))) & (kind_of(e["target"]) == "SECRET"))
    named = (F.coalesce("asset_node", F.lit("")) != "") & (F.coalesce("sink_node", F.lit("")) != "")
    claims = F.exists(F.concat(edges, assoc), lambda e: (e["source"] == F.col("asset_node")) & (e["target"] == F.col("sink_node")))
    runs = (
        (F.size(nodes) == 2) & (F.size(edges) == 1) & (F.get(edges, F.lit(0))["type"] == "EXECUTES")
        & (kind_of(F.get(nodes, F.lit(0))) == "SKILL") & (kind_of(F.get(nodes, F.lit(1))) == "ACTION")
    )

    def clause(token: str, ok: Column) -> Column:
        return F.struct(F.lit(token).alias("clause"), F.coalesce(ok, F.lit(False)).alias("ok"))

    exfil = F.array(
        clause("reads-into-asset", (at >= 1) & (F.get(edges, at - 1)["type"] == "READS")),
        clause("sends-to-endpoint", sends & (kind_of(tx.last(nodes)) == "ENDPOINT")),
        clause("flows-to-lineage", (at >= 0) & (F.size(edges) > at) & sends & F.forall(tail, lambda e: e["type"] == "FLOWS_TO")),
        clause("asset-kind-matches-type", kind_of(F.get(nodes, at)) == wanted),
    )
    shared = F.array(
        clause("skill-executes-action", runs),
        clause("associated-secret-read", reads),
        clause("no-secret-to-action-edge", named & ~claims),
    )
    rest = F.when(F.col("attack_type").isin("SECRET_EXFILTRATION", "DATA_EXFILTRATION"), exfil).otherwise(shared)
    # a path that is no walk counts as UNKNOWN, and UNKNOWN has nothing to prove
    return (
        paths.where("attack_type <> 'UNKNOWN'")
        .withColumn("_asset", asset_index(nodes))
        .where(is_contiguous(nodes, edges) & (F.size(nodes) > 0))
        .select("path_id", "attack_type", F.inline(F.concat(F.array(clause("contiguous-walk", F.lit(True))), rest)))
    )
