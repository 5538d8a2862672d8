"""Scores, levels, coverage verdicts, gates and listings per target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators.targets import by_target

PARTIAL_KINDS = ["skipped", "rule_error", "decode_error"]


def _active() -> Column:
    return ~F.coalesce(F.col("suppressed"), F.lit(False))


def with_suppressed(findings: DataFrame) -> DataFrame:
    if "suppressed" in findings.columns:
        return findings
    return findings.withColumn("suppressed", F.lit(False))


def weight_of(severity: Column) -> Column:
    return tx.map_lookup(severity, vocab.SEVERITY_WEIGHT, 0)


def level_of(score: Column) -> Column:
    expr = None
    for bound, name in vocab.RISK_BUCKETS:
        expr = F.when(score >= bound, F.lit(name)) if expr is None else expr.when(score >= bound, F.lit(name))
    return expr.otherwise(F.lit("SAFE"))


def scores(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Capped sum of severity weights of the unsuppressed findings, and its level."""
    total = F.sum(F.when(_active(), weight_of(F.col("severity"))).otherwise(0))
    return (
        with_suppressed(findings)
        .groupBy(*keys)
        .agg(F.least(total, F.lit(vocab.MAX_SCORE)).cast("int").alias("score"))
        .withColumn("risk_level", level_of(F.col("score")))
    )


def severity_summary(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = [
        F.count_if(_active() & (F.col("severity") == s)).alias(s.lower())
        for s in vocab.SEVERITIES if s != "INFO"
    ]
    return with_suppressed(findings).groupBy(*keys).agg(
        *counts, F.count_if(F.col("suppressed")).alias("suppressed")
    )


def coverage_status(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """full, partial or none, from coverage events (kind, reason)."""
    kind, reason = F.col("kind"), F.col("reason")
    read = kind.isin("scanned", "decode_error")
    hole = kind.isin(PARTIAL_KINDS) | ((kind == "pruned") & (reason == "vendored_dir"))
    return (
        events.groupBy(*keys)
        .agg(F.count_if(read).alias("files_scanned"), F.count_if(F.coalesce(hole, F.lit(False))).alias("holes"))
        .withColumn(
            "coverage_status",
            F.when(F.col("files_scanned") <= 0, F.lit("none"))
            .when(F.col("holes") > 0, F.lit("partial"))
            .otherwise(F.lit("full")),
        )
    )


def coverage_by_reason(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.groupBy(*keys, "kind", "reason").agg(F.count("*").alias("n"))


def unknown_reasons(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Why a verdict is open, in the words of the account."""
    kind = F.col("kind")
    counted = events.groupBy(*keys).agg(
        F.count_if(kind == "skipped").alias("a"),
        F.count_if(kind == "decode_error").alias("b"),
        F.count_if(kind == "rule_error").alias("c"),
        F.count_if((kind == "pruned") & (F.col("reason") == "vendored_dir")).alias("d"),
    )

    def say(name: str, words: str) -> Column:
        return F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"), F.lit(words)))

    stated = F.array_compact(
        F.array(
            say("a", " skipped files"), say("b", " lossy files"), say("c", " rule errors"),
            say("d", " vendored dirs not entered"),
        )
    )
    return counted.select(
        *keys,
        F.when(F.size(stated) > 0, F.array_join(stated, ", ")).otherwise(F.lit("nothing was read")).alias("reasons"),
    )


@by_target()
def risk_with_coverage(scored: DataFrame, coverage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A zero score counts as SAFE only when everything was read."""
    joined = coverage.join(scored, list(keys), "full_outer")
    score = F.coalesce("score", F.lit(0))
    level = level_of(score)
    status = F.coalesce("coverage_status", F.lit("none"))
    return joined.select(
        *keys,
        score.alias("score"),
        status.alias("coverage_status"),
        F.when((level == "SAFE") & (status != "full"), F.lit("UNKNOWN")).otherwise(level).alias("risk_level"),
    )


def finding_classes(findings: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per rule: count, worst severity, title of the first finding in scan order."""
    active = with_suppressed(findings).where(_active())
    return active.groupBy(*keys, "rule_id").agg(
        F.count("*").alias("n"),
        tx.severity_name(F.max(tx.severity_rank(F.col("severity")))).alias("severity"),
        F.min_by("title", F.struct(*[F.col(c) for c in order])).alias("title"),
    )


def matched_by_severity(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings a baseline already lists, per severity."""
    return (
        with_suppressed(findings)
        .where((F.col("baseline_state") == "matched") & _active())
        .groupBy(*keys, "severity")
        .agg(F.count("*").alias("n"))
    )


def highest_risk_path(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Top path by score, then severity, then path order."""
    rank = tx.severity_rank(F.col("risk_severity"))
    best = F.min_by(
        F.struct("path_id", "attack_type", "risk_severity", "risk_score"),
        F.struct((-F.col("risk_score")).alias("s"), (-rank).alias("r"), F.col("path_id").alias("p")),
    )
    return paths.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


@by_target()
def gate(findings: DataFrame, keys: Sequence[str], fail_on: str = "HIGH", only_new: bool = False,
         policy_status: DataFrame | None = None) -> DataFrame:
    """Exit code per target: 2 for CRITICAL, 1 at the threshold or for a failed policy, else 0."""
    rows = with_suppressed(findings)
    counts = _active()
    if only_new:
        counts &= ~F.coalesce(F.col("baseline_state") == "matched", F.lit(False))
    worst = F.max(F.when(counts, tx.severity_rank(F.col("severity"))))
    code = (
        F.when(F.col("worst") >= vocab.SEVERITY_RANK["CRITICAL"], 2)
        .when(F.col("worst") >= vocab.SEVERITY_RANK[fail_on], 1)
        .otherwise(0)
    )
    result = rows.groupBy(*keys).agg(worst.alias("worst")).select(*keys, code.alias("exit_code"))
    if policy_status is None:
        return result
    failed = F.when(F.col("policy_status") == "FAIL", 1).otherwise(0)
    return result.join(policy_status, list(keys), "full_outer").select(
        *keys, F.greatest(F.coalesce("exit_code", F.lit(0)), failed).alias("exit_code")
    )


def record_index(ids: DataFrame, id_column: str, limit: int = vocab.MAX_LISTED_IDS) -> DataFrame:
    """The first ids in order and how many more there are (a top-k listing)."""
    total = ids.agg(F.count("*")).scalar()
    return ids.select(id_column).orderBy(id_column).limit(limit).select(
        id_column, total.alias("total"), F.greatest(total - limit, F.lit(0)).alias("not_shown")
    )


def ranked(frame: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """``rank`` of every row within its key, 1-based, safe for a key that holds most rows.

    ``chunk`` must grow with the order. Rows are numbered inside (key, chunk);
    the offsets come from a prefix sum over chunk counts, a table far smaller
    than the rows.
    """
    marked = frame.withColumn("_chunk", chunk)
    sizes = marked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = marked.withColumn("_rn", F.row_number().over(inside))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_chunk"]]
    cond = same[0]
    for c in same[1:]:
        cond &= c
    return (
        numbered.alias("l")
        .join(offsets.alias("r"), cond)
        .select("l.*", (F.col("l._rn") + F.col("r._offset")).alias("rank"))
        .drop("_chunk", "_rn")
    )
