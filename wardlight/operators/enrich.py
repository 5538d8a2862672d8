"""Public metadata, confidence and suppression marks for findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx


def cwe_of(rule_id: Column) -> Column:
    """Weakness ids of a rule, an empty array when none is defensible."""
    expr = None
    for rule, ids in vocab.CWE.items():
        value = F.array(*[F.lit(i) for i in ids])
        expr = F.when(rule_id == rule, value) if expr is None else expr.when(rule_id == rule, value)
    return expr.otherwise(F.array().cast("array<string>"))


def _technique(pair: tuple[str, str]) -> Column:
    return F.struct(F.lit(pair[0]).alias("id"), F.lit(pair[1]).alias("name"))


def mitre_of(rule_id: Column, evidence: Column) -> Column:
    """Techniques of a rule; a Unix shell in the evidence adds one."""
    expr = None
    for rule, pair in vocab.MITRE.items():
        value = F.array(_technique(pair))
        expr = F.when(rule_id == rule, value) if expr is None else expr.when(rule_id == rule, value)
    base = expr.otherwise(F.array().cast("array<struct<id:string,name:string>>"))
    shell = (rule_id == "AS-002") & tx.any_contains(F.coalesce(evidence, F.lit("")), vocab.UNIX_SHELL_EVIDENCE)
    return F.when(shell, F.concat(base, F.array(_technique(vocab.UNIX_SHELL)))).otherwise(base)


def confidence_of(rule_id: Column, evidence: Column) -> Column:
    """How firmly the match supports the claim (not how bad the claim is)."""
    strong = rule_id.startswith("AS-CHAIN") | rule_id.isin("AS-007", "AS-006")
    provider = (rule_id == "AS-001") & tx.any_contains(
        F.coalesce(evidence, F.lit("")), ["API credential detected", "Private key block"]
    )
    return F.when(strong | provider, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def enrich(findings: DataFrame) -> DataFrame:
    """Adds ``cwe``, ``mitre`` and ``confidence``; fills ``matched_text`` from the evidence."""
    rule_id, evidence = F.col("rule_id"), F.col("evidence")
    shown = F.col("matched_text") if "matched_text" in findings.columns else F.lit(None).cast("string")
    return (
        findings.withColumn("cwe", cwe_of(rule_id))
        .withColumn("mitre", mitre_of(rule_id, evidence))
        .withColumn("confidence", confidence_of(rule_id, evidence))
        .withColumn("matched_text", F.coalesce(F.nullif(shown, F.lit("")), evidence, F.lit("")))
    )


def suppress(findings: DataFrame, rules: Sequence[str] = (), servers: Sequence[str] = (),
             domains: Sequence[str] = ()) -> DataFrame:
    """Mark findings a project ignores: by rule, else by server name, else by domain.

    Nothing is removed. The lists come from a project's settings file, so they
    are expressions, not joins.
    """
    reason = F.when(F.lit(False), F.lit(None).cast("string"))
    if rules:
        reason = reason.when(
            F.col("rule_id").isin(list(rules)), F.concat(F.lit("rule "), "rule_id", F.lit(" ignored"))
        )
    for server in servers:
        reason = reason.when(
            F.col("description").contains(f"'{server}'"), F.lit(f"MCP server '{server}' ignored")
        )
    wanted = [d.lower().strip() for d in domains if d.strip()]
    if wanted:
        reason = reason.when(tx.any_contains(F.lower("evidence"), wanted), F.lit("domain ignored"))
    return findings.withColumn("suppression_reason", reason).withColumn(
        "suppressed", F.col("suppression_reason").isNotNull()
    )
