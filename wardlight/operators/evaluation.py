"""Labelled cases and benchmark evaluations: joins, set differences and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import text as tx
from wardlight.session import constant_table

CASE = ["benchmark_id", "case_id"]
# fixed values
DEFAULT_STATUS = "completed"
DEFAULT_MESSAGE = "Benchmark evaluation completed."
LISTS = ["threat_ids", "threat_categories", "attack_behaviors", "entry_conditions", "expected_security_properties"]
# fixed values: entry id, name (public taxonomy terms); summaries are our own
TAXONOMY_ID = "owasp-agentic-2026"
TAXONOMY_NAME = "OWASP Top 10 for Agentic Applications"
TAXONOMY = [
    ("ASI01", "Agent Goal Hijack", "The agent is steered towards a goal its user did not set."),
    ("ASI02", "Tool Misuse and Exploitation", "A tool is called in a harmful or unintended way."),
    ("ASI03", "Identity and Privilege Abuse", "Identity or rights of an agent are used without authority."),
    ("ASI04", "Agentic Supply Chain Vulnerabilities", "A weak or hostile part enters through the supply chain."),
    ("ASI05", "Unexpected Code Execution (RCE)", "The agent is led to run code nobody asked for."),
    ("ASI06", "Memory & Context Poisoning", "Planted content distorts later reasoning."),
    ("ASI07", "Insecure Inter-Agent Communication", "Messages between agents are read or changed on the way."),
    ("ASI08", "Cascading Failures", "One failing agent takes others down with it."),
    ("ASI09", "Human-Agent Trust Exploitation", "Human trust in an agent is turned against them."),
    ("ASI10", "Rogue Agents", "An agent acts outside the will of its owner."),
]
DETECTION = ["HIGH", "CRITICAL"]
RESULTS = {"DETECTED": "detected", "PARTIALLY_DETECTED": "partially_detected", "MISSED": "missed", "FALSE_POSITIVE": "false_positives"}


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(TAXONOMY_ID, *row) for row in TAXONOMY]
    return constant_table(spark, ["taxonomy_id", "entry_id", "name", "description"], rows)


def duplicate_entries(entries: DataFrame) -> DataFrame:
    """Entry ids a taxonomy holds more than once."""
    return entries.groupBy("taxonomy_id", "entry_id").agg(F.count("*").alias("n")).where("n > 1")


def adapt_cases(raw: DataFrame, benchmark_id: str) -> tuple[DataFrame, DataFrame]:
    """Vendor cases as JSON (``json``) to unified cases, and the cases refused with a reason.

    ``case_id``, ``name`` and ``description`` must be non-blank strings; the
    list fields are optional, trimmed, de-duplicated and sorted.
    """
    schema = "case_id string, name string, description string, " + ", ".join(f"{c} array<string>" for c in LISTS)
    rows = raw.withColumn("c", F.from_json("json", schema))
    need = ["case_id", "name", "description"]
    missing = F.array_compact(F.array(*[F.when(tx.strip(F.coalesce(F.col(f"c.{c}"), F.lit(""))) == "", F.lit(c)) for c in need]))
    rows = rows.withColumn("_missing", missing)
    good = rows.where(F.size("_missing") == 0).select(
        F.lit(benchmark_id).alias("benchmark_id"),
        *[tx.strip(F.col(f"c.{c}")).alias(c) for c in need],
        *[tx.clean_set(F.col(f"c.{c}")).alias(c) for c in LISTS],
    )
    refused = rows.where(F.size("_missing") > 0).select("json", F.concat(F.lit("empty "), F.array_join("_missing", ", ")).alias("reason"))
    return good, refused


def violated(expected: Column, observed: Column) -> Column:
    """Expected properties that were not observed, sorted."""
    return F.array_sort(F.array_except(tx.clean_set(expected), tx.clean_set(observed)))


def _message(column: str) -> Column:
    text = F.coalesce(F.col(column), F.lit(""))
    return F.when(tx.strip(text) == "", F.lit(DEFAULT_MESSAGE)).otherwise(tx.strip(text))


def evaluate(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """Case by observation: passed means nothing expected was violated; the status says nothing about it."""
    joined = cases.select(*CASE, "expected_security_properties").join(observations, CASE)
    missing = violated(F.col("expected_security_properties"), F.col("observed_properties"))
    status = F.col("status") if "status" in observations.columns else F.lit(DEFAULT_STATUS)
    message = _message("message") if "message" in observations.columns else F.lit(DEFAULT_MESSAGE)
    return joined.select(
        *CASE, missing.alias("violated_properties"), tx.clean_set(F.col("observed_properties")).alias("observed_properties"),
        (F.size(missing) == 0).alias("passed"), F.coalesce(status, F.lit(DEFAULT_STATUS)).alias("status"), message.alias("message"),
    )


def unbound(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """Executions without a case and cases without an execution: (identity, problem)."""
    extra = observations.select(*CASE).distinct().join(cases.select(*CASE), CASE, "left_anti").withColumn("problem", F.lit("no such case"))
    idle = cases.select(*CASE).join(observations.select(*CASE).distinct(), CASE, "left_anti").withColumn("problem", F.lit("not executed"))
    return extra.unionByName(idle)


def evaluate_executions(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """Bound executions judged by their properties alone; status and message are not passed on."""
    return evaluate(cases, observations.select(*CASE, "observed_properties"))


def summarize(results: DataFrame) -> DataFrame:
    """Per benchmark: passed, failed and error cases; an error status outranks passed."""
    error = F.col("status") == "error"
    return results.groupBy("benchmark_id").agg(
        F.count("*").alias("total_cases"),
        F.count_if(~error & F.col("passed")).alias("passed_cases"),
        F.count_if(~error & ~F.col("passed")).alias("failed_cases"),
        F.count_if(error).alias("error_cases"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("benchmark_id", F.trim("status").alias("status")).agg(F.count("*").alias("n"))


def summary_violations(summaries: DataFrame, statuses: DataFrame) -> DataFrame:
    """Summaries whose parts do not add up."""
    total = statuses.groupBy("benchmark_id").agg(F.sum("n").alias("by_status"))
    return summaries.join(total, "benchmark_id", "left").where(
        "total_cases <> passed_cases + failed_cases + error_cases OR total_cases <> coalesce(by_status, 0)"
    ).select("benchmark_id")


def cross_benchmark(summaries: DataFrame) -> DataFrame:
    """Totals over all benchmarks."""
    return summaries.agg(
        F.count("*").alias("total_benchmarks"), F.sum("total_cases").alias("total_cases"), F.sum("passed_cases").alias("passed_cases"),
        F.sum("failed_cases").alias("failed_cases"), F.sum("error_cases").alias("error_cases"),
    )


def duplicate_benchmarks(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("benchmark_id").agg(F.count("*").alias("n")).where("n > 1")


def map_threats(scenarios: DataFrame, entries: DataFrame) -> DataFrame:
    """scenario -> threat id -> taxonomy entry; an id without an entry keeps null."""
    named = scenarios.select("scenario_id", F.explode(tx.clean_set(F.col("threat_ids"))).alias("threat_id"))
    return named.join(entries.select(F.col("entry_id").alias("threat_id"), "taxonomy_id", F.col("name").alias("entry_name")), "threat_id", "left").select(
        "scenario_id", "threat_id", "taxonomy_id", "entry_name"
    )


def classify_cases(cases: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DETECTED, PARTIALLY_DETECTED, MISSED or FALSE_POSITIVE per labelled case.

    ``cases``: keys, category, expected_rules, is_benign. Findings are first
    reduced to one row per (case, rule).
    """
    rules = findings.groupBy(*keys, "rule_id").agg(F.bool_or(F.col("severity").isin(DETECTION)).alias("strong"))
    expected = cases.select(*keys, "expected_rules", "is_benign").join(rules, list(keys), "left")
    facts = expected.groupBy(*keys).agg(
        F.coalesce(F.bool_or("strong"), F.lit(False)).alias("strong"),
        F.coalesce(F.bool_or(F.col("rule_id").isNotNull()), F.lit(False)).alias("any_rule"),
        F.coalesce(F.bool_or(F.array_contains("expected_rules", F.col("rule_id"))), F.lit(False)).alias("wanted"),
    )
    listed = F.size(F.coalesce("expected_rules", F.array().cast("array<string>"))) > 0
    result = (
        F.when(F.col("is_benign"), F.when(F.col("strong"), F.lit("FALSE_POSITIVE")).otherwise(F.lit("DETECTED")))
        .when(F.col("strong"), F.lit("DETECTED"))
        .when(F.when(listed, F.col("wanted")).otherwise(F.col("any_rule")), F.lit("PARTIALLY_DETECTED"))
        .otherwise(F.lit("MISSED"))
    )
    return cases.join(facts, list(keys)).withColumn("result", result).drop("strong", "any_rule", "wanted")


def _result_counts() -> list[Column]:
    return [F.count_if(F.col("result") == k).alias(v) for k, v in RESULTS.items()]


def lab_summary(results: DataFrame) -> DataFrame:
    share = F.bround(100 * F.col("detected") / F.col("total"), 1)
    return results.agg(F.count("*").alias("total"), *_result_counts()).withColumn(
        "detection_percentage", F.when(F.col("total") > 0, share).otherwise(F.lit(0.0))
    )


def lab_by_category(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(F.count("*").alias("total"), *_result_counts())


def precision(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TP / (TP + FP) with its 95 % Wilson interval; INCONCLUSIVE stays outside."""
    z = 1.959963984540054
    counted = verdicts.groupBy(*keys).agg(
        F.count_if(F.col("verdict") == "TP").alias("tp"), F.count_if(F.col("verdict") == "FP").alias("fp"),
        F.count_if(F.col("verdict") == "INCONCLUSIVE").alias("inconclusive"),
    )
    n = (F.col("tp") + F.col("fp")).cast("double")
    p = F.col("tp") / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    decided = n > 0
    return counted.select(
        *keys, "tp", "fp", "inconclusive",
        F.when(decided, F.round(p, 6)).alias("precision"), F.when(decided, F.round(centre - half, 6)).alias("low"),
        F.when(decided, F.round(centre + half, 6)).alias("high"),
    )
