"""Policies over finished paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.operators.targets import by_target


def _policy_rows(enabled: Sequence[str] | None) -> Column:
    known = {p[0] for p in vocab.POLICIES}
    unknown = set(enabled or ()) - known
    if unknown:
        raise ValueError(f"policies without a known trigger: {sorted(unknown)}")
    rows = [p for p in vocab.POLICIES if enabled is None or p[0] in enabled]
    return F.array(*[
        F.struct(F.lit(p[0]).alias("policy_id"), F.lit(p[1]).alias("trigger"), F.lit(p[2]).alias("description"), F.lit(p[3]).alias("why"))
        for p in rows
    ])


def evaluate(paths: DataFrame, enabled: Sequence[str] | None = None) -> DataFrame:
    """Every enabled policy on every path: violated or not, and why.

    The policies are a constant array unfolded per path; nothing is joined. A
    path without an identity stops the job.
    """
    kept = [c for c in paths.columns if c not in ("path_id", "attack_type")]
    identified = F.when(F.coalesce("path_id", F.lit("")) == "", F.raise_error(F.lit("a path has no path_id"))).otherwise(F.col("path_id"))
    rows = paths.select(*kept, identified.alias("path_id"), "attack_type", F.inline(_policy_rows(enabled)))
    violated = F.col("attack_type") == F.col("trigger")
    return rows.select(
        *kept, "policy_id", "path_id", violated.alias("violated"),
        F.when(violated, F.col("why")).otherwise(F.col("description")).alias("reason"),
    )


@by_target()
def violated_ids(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sorted ids of the policies each path violates (at most one per policy); paths that violate none have no row."""
    return results.where("violated").groupBy(*keys, "path_id").agg(F.array_sort(F.collect_set("policy_id")).alias("policy_ids"))


@by_target()
def associate(paths: DataFrame, results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sorted ids of the policies of each path, an empty list for paths that violate none."""
    own = [*keys, "path_id"]
    return paths.select(*own).join(violated_ids(results, keys), own, "left").select(
        *own, F.coalesce("policy_ids", F.array().cast("array<string>")).alias("policy_ids")
    )


def violated_types(types: DataFrame, enabled: Sequence[str] | None = None) -> DataFrame:
    """(keys, attack_type) rows as (keys, violated): what a verdict needs, without a path."""
    triggers = [t for i, t, *_ in vocab.POLICIES if enabled is None or i in enabled]
    return types.withColumn("violated", F.col("attack_type").isin(triggers)).drop("attack_type")


@by_target()
def status(results: DataFrame, coverage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FAIL when anything is violated, PASS only with full coverage, else UNKNOWN."""
    failed = results.groupBy(*keys).agg(F.bool_or("violated").alias("failed"))
    return coverage.join(failed, list(keys), "full_outer").select(
        *keys,
        F.when(F.coalesce("failed", F.lit(False)), F.lit("FAIL"))
        .when(F.coalesce("coverage_status", F.lit("none")) != "full", F.lit("UNKNOWN"))
        .otherwise(F.lit("PASS"))
        .alias("policy_status"),
    )


def violation_counts(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations per target and policy, repeats counted."""
    return results.where("violated").groupBy(*keys, "policy_id").agg(F.count("*").alias("violations"))


def violated_paths(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The violated (policy, path) rows themselves, in report order when sorted by both."""
    return results.where("violated").select(*keys, "policy_id", "path_id")
