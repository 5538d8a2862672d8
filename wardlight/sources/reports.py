"""Report documents: findings as JSON, and the parts of a SARIF run.

A target may have any number of findings, so documents are ordered rows: the lines of
a target, in the order of (section, pos), are its document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators.scoring import ranked

CHUNK = 4096


def _some(column: str, present: Column) -> Column:
    return F.when(present, F.col(column)).alias(column)


def finding_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding; empty optional fields are left out."""
    optional = {
        "mitre": F.size("mitre") > 0, "cwe": F.size("cwe") > 0,
        "matched_text": F.coalesce("matched_text", F.lit("")) != "",
    }
    always = [c for c in ("rule_id", "severity", "title", "description", "file", "line", "evidence", "remediation", "confidence", "suppressed", "suppression_reason", "baseline_state") if c in findings.columns]
    more = [_some(c, cond) for c, cond in optional.items() if c in findings.columns]
    return findings.withColumn("json", F.to_json(F.struct(*always, *more)))


def _listed(rows: DataFrame, keys: Sequence[str], section: int, order: Sequence[str], chunk: Column) -> DataFrame:
    """Rows of one list of a document: (keys, section, pos, json), with commas between them."""
    placed = ranked(rows, keys, order, chunk)
    text = F.when(F.col("rank") > 1, F.concat(F.lit(","), "json")).otherwise(F.col("json"))
    return placed.select(*keys, F.lit(section).alias("section"), F.col("rank").cast("long").alias("pos"), text.alias("json"))


def _fixed(targets: DataFrame, keys: Sequence[str], section: int, text: Column) -> DataFrame:
    return targets.select(*keys, F.lit(section).alias("section"), F.lit(0).cast("long").alias("pos"), text.alias("json"))


def scan_json(findings: DataFrame, scores: DataFrame, summary: DataFrame, coverage: DataFrame, keys: Sequence[str],
              order: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """One document per target as ordered rows: score, level, counts and coverage, then every finding.

    ``chunk`` must grow with ``order``; it spreads the numbering of a target with many findings.
    """
    sizes = findings.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = scores.join(summary, list(keys), "full_outer").join(coverage, list(keys), "full_outer").join(sizes, list(keys), "left")
    counts = F.struct("critical", "high", "medium", "low", "suppressed")
    head = F.to_json(F.struct(
        F.concat_ws("/", *keys).alias("target"), F.coalesce("score", F.lit(0)).alias("score"), "risk_level", counts.alias("summary"),
        F.struct("coverage_status", "files_scanned").alias("coverage"), F.coalesce("n", F.lit(0)).alias("n_findings"),
    ))
    opening = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"findings":['))
    rows = _listed(finding_json(findings), keys, 1, order, F.lit(0) if chunk is None else chunk)
    return _fixed(joined, keys, 0, opening).unionByName(rows).unionByName(_fixed(joined, keys, 2, F.lit("]}")))


def level_of(severity: Column) -> Column:
    return tx.map_lookup(severity, vocab.SARIF_LEVEL, "note")


def _uri(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def superseding_paths(paths: DataFrame, entry_files: DataFrame) -> DataFrame:
    """Per file the proven path that stands for chain findings of that file: the last by id."""
    rows = entry_files.join(paths.select("path_id", "attack_type", "risk_severity"), "path_id")
    best = F.max(F.struct("path_id", "attack_type", "risk_severity"))
    return rows.groupBy(_uri(F.col("file")).alias("uri")).agg(best.alias("m")).select(
        "uri", F.col("m.path_id").alias("super_id"), F.col("m.attack_type").alias("super_type"), F.col("m.risk_severity").alias("super_risk")
    )


def sarif_results(findings: DataFrame, superseding: DataFrame | None = None) -> DataFrame:
    """Findings as SARIF results: level, message, location, suppressions, baseline state."""
    rows = findings.withColumn("uri", F.nullif(_uri(F.coalesce("file", F.lit(""))), F.lit("")))
    if superseding is None:
        for c in ("super_id", "super_type", "super_risk"):
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    else:
        rows = rows.join(superseding, "uri", "left")
    superseded = F.col("super_id").isNotNull() & F.col("rule_id").startswith("AS-CHAIN-")
    because = F.concat(
        F.lit("Superseded by proven attack path "), "super_id", F.lit(" ("), "super_type", F.lit(", risk "), "super_risk",
        F.lit("); the path carries the full node/edge lineage for the same artifact."),
    )

    def excuse(kind: str, words: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), words.alias("justification"))

    suppressions = F.array_compact(F.array(
        F.when(superseded, excuse("inSource", because)),
        F.when(F.coalesce("suppressed", F.lit(False)), excuse("external", F.coalesce("suppression_reason", F.lit("suppressed")))),
    ))
    shown = F.coalesce("matched_text", F.lit(""))
    message = F.when(shown != "", F.concat("title", F.lit(": "), shown)).otherwise(F.col("title"))
    region = F.when(F.coalesce("line", F.lit(0)) > 0, F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    state = F.when(F.col("baseline_state") == "new", F.lit("new")).when(F.col("baseline_state") == "matched", F.lit("unchanged"))
    return rows.select(
        *[c for c in findings.columns],
        F.col("uri"),
        level_of(F.col("severity")).alias("level"),
        message.alias("message"),
        F.when(superseded, F.col("super_id")).alias("superseded_by_path"),
        F.when(F.size(suppressions) > 0, suppressions).alias("suppressions"),
        state.alias("baselineState"),
        F.when(F.col("uri").isNotNull(), F.array(place)).alias("locations"),
    )


def result_json(results: DataFrame) -> DataFrame:
    body = F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.struct(F.lit("finding").alias("result_kind"), "superseded_by_path").alias("properties"),
        "locations", "suppressions", "baselineState",
    )
    return results.withColumn("json", F.to_json(body))


def path_results(paths: DataFrame, entry_files: DataFrame, policy_ids: DataFrame) -> DataFrame:
    """Attack paths as SARIF results; a location only when the entry file is known."""
    joined = paths.join(entry_files, "path_id", "left").join(policy_ids, "path_id", "left")
    known = F.col("file").isNotNull()
    props = F.struct(
        F.lit("attack_path").alias("result_kind"), "path_id", "attack_type", "risk_severity", "risk_confidence", "risk_score", "evidence",
        F.when(F.size("policy_ids") > 0, F.col("policy_ids")).alias("policy_ids"),
        F.when(known, F.lit("entry_node_skill_file")).otherwise(F.lit("omitted")).alias("location_provenance"),
    )
    place = F.struct(F.struct(F.struct(_uri(F.col("file")).alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    words = F.coalesce(F.nullif("explanation", F.lit("")), F.col("attack_type"))
    body = F.struct(
        F.concat(F.lit("ATTACK-PATH-"), "attack_type").alias("ruleId"), level_of(F.col("risk_severity")).alias("level"),
        F.struct(words.alias("text")).alias("message"), props.alias("properties"), F.when(known, F.array(place)).alias("locations"),
    )
    return joined.select("path_id", F.concat(F.lit("ATTACK-PATH-"), "attack_type").alias("ruleId"), F.to_json(body).alias("json"))


def sarif_rules(findings: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One descriptor per target and rule, taken from its first finding in scan order."""
    first = F.min_by(
        F.struct("title", "description", "remediation", "mitre", "cwe", "confidence"), F.struct(*[F.col(c) for c in order])
    )
    rows = findings.groupBy(*keys, "rule_id").agg(first.alias("f"))
    props = F.struct(
        F.when(F.size("f.mitre") > 0, F.col("f.mitre")).alias("mitre"), F.when(F.size("f.cwe") > 0, F.col("f.cwe")).alias("cwe"), "f.confidence"
    )
    body = F.struct(
        F.col("rule_id").alias("id"), F.col("rule_id").alias("name"), F.struct(F.col("f.title").alias("text")).alias("shortDescription"),
        F.struct(F.col("f.description").alias("text")).alias("fullDescription"),
        F.when(F.coalesce("f.remediation", F.lit("")) != "", F.struct(F.col("f.remediation").alias("text"))).alias("help"), props.alias("properties"),
    )
    return rows.select(*keys, "rule_id", F.col("f.title").alias("title"), F.to_json(body).alias("json"))


def sarif_artifacts(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct files with findings."""
    uri = _uri(F.col("file"))
    return findings.select(*keys, uri.alias("uri")).distinct().withColumn(
        "json", F.to_json(F.struct(F.struct("uri").alias("location")))
    )


def sarif_run(results: DataFrame, rules: DataFrame, artifacts: DataFrame, keys: Sequence[str], order: Sequence[str],
              chunk: Column | None = None) -> DataFrame:
    """One SARIF document per target as ordered rows: tool with its rules, artifacts, results.

    ``results``: rows of :func:`result_json` or :func:`path_results` with the keys and ``order``;
    ``rules`` and ``artifacts``: as made here. A target without results has no document.
    """
    targets = results.select(*keys).distinct()
    head = F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"wardlight","rules":[')
    none = F.lit(0)
    parts = [
        _fixed(targets, keys, 0, head), _listed(rules, keys, 1, ["rule_id"], none), _fixed(targets, keys, 2, F.lit(']}},"artifacts":[')),
        _listed(artifacts, keys, 3, ["uri"], none), _fixed(targets, keys, 4, F.lit('],"results":[')),
        _listed(results, keys, 5, order, none if chunk is None else chunk), _fixed(targets, keys, 6, F.lit("]}]}")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write_documents(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Ordered rows as text, one folder per target; its part files in name order are the document."""
    ordered = rows.repartitionByRange(*keys, "section", "pos").sortWithinPartitions(*keys, "section", "pos")
    ordered.select(*keys, F.col("json").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def write_parts(rows: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """JSON texts as lines, one folder per target."""
    writer = rows.select(*keys, F.col("json").alias("value")).write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).text(path)
