"""Corpus accounting, enrichment, suppression and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators import enrich as en
from wardlight.operators import scoring as sc
from wardlight.plans.q_rules import FINDINGS_SQL, seeded_findings
from wardlight.plans.sqltext import names, q
from wardlight.sources import corpus
from wardlight.sources.corpus import read_table, read_texts

# ------------------------------------------------------------------ file tree
ENDINGS = [".md", ".py", ".png", ".json", ".txt", ".env", "", ".SH"]
FOLDERS = ["src", "node_modules/lib", "docs", ".git/hooks", "a/dist/b", "src/tools", "notes"]


def file_tree(spark: SparkSession, folder: str) -> DataFrame:
    """documents as files: names, folders and bytes of many kinds, one target per source."""
    n = F.col("doc_id")
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), (n % 8).cast("int"))
    place = F.get(F.array(*[F.lit(e) for e in FOLDERS]), (n % 7).cast("int"))
    name = F.when(n % 11 == 0, F.lit("SKILL.md")).otherwise(F.concat(F.lit("f"), n.cast("string"), ending))
    utf8 = F.encode("text", "UTF-8")
    content = (
        F.when(n % 9 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(n % 9 == 1, F.concat(F.unhex(F.lit("6100")), utf8))
        .when(n % 9 == 2, F.concat(utf8, F.unhex(F.lit("FF"))))
        .when(n % 9 == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"), F.unhex(F.lit("00"))))
        .when(n % 9 == 4, F.concat(F.unhex(F.lit("FFFE0000")), F.unhex(F.regexp_replace(F.hex(F.encode("text", "UTF-32")), "(..)(..)(..)(..)", "$4$3$2$1"))))
        .otherwise(utf8)
    )
    return read_texts(spark, folder, "documents", "doc_id", "source", "text", "n_chars").select(
        "doc_id",
        "source",
        F.concat(F.lit("tree/"), "source", F.lit("/"), place, F.lit("/d"), n.cast("string"), F.lit("/"), name).alias("path"),
        F.when(n % 17 == 0, F.lit(2_000_000).cast("long")).otherwise(F.col("n_chars")).alias("length"),
        content.alias("content"),
    )


def _case(values, column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


TREE_SQL = f"""tree AS (SELECT *, 'tree/' || source || '/' || place || '/d' || doc_id || '/' || name AS path,
    CASE WHEN doc_id % 17 = 0 THEN 2000000 ELSE n_chars END AS length
  FROM (SELECT *, {_case(FOLDERS, 'doc_id % 7')} AS place,
      CASE WHEN doc_id % 11 = 0 THEN 'SKILL.md' ELSE 'f' || doc_id || {_case(ENDINGS, 'doc_id % 8')} END AS name,
      doc_id % 9 AS variant FROM documents)),
judged AS (SELECT *,
    CASE WHEN NOT (name = 'SKILL.md' OR lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) IN {names(vocab.SCAN_EXTENSIONS)}) THEN 'not_scannable'
      WHEN length > 1000000 THEN 'too_large'
      WHEN variant = 1 OR variant = 3 THEN 'binary' END AS skip_reason,
    place IN ('node_modules/lib', '.git/hooks', 'a/dist/b') AS pruned FROM tree),
events_of AS (
  SELECT source, 'skipped' AS kind, path, skip_reason AS reason FROM judged WHERE NOT pruned AND skip_reason IS NOT NULL
  UNION ALL SELECT source, CASE WHEN variant = 2 THEN 'decode_error' ELSE 'scanned' END, path,
    CASE WHEN variant = 2 THEN 'decode_error' END FROM judged WHERE NOT pruned AND skip_reason IS NULL
  UNION ALL SELECT DISTINCT source, 'pruned', 'tree/' || source || '/' || CASE place WHEN 'node_modules/lib' THEN 'node_modules'
    WHEN '.git/hooks' THEN '.git' ELSE 'a/dist' END, CASE place WHEN '.git/hooks' THEN 'ignored_dir' ELSE 'vendored_dir' END
  FROM judged WHERE pruned)"""


def admission(spark: SparkSession, folder: str) -> DataFrame:
    files = file_tree(spark, folder)
    return corpus.decode(files, vocab.MAX_FILE_SIZE).select("path", "length", F.coalesce("skip_reason", F.lit("read")).alias("verdict"))


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.decode(file_tree(spark, folder), vocab.MAX_FILE_SIZE).where("text IS NOT NULL")
    return rows.select("path", "lossy", F.md5("text").alias("text_hash"))


def _tree_events(spark: SparkSession, folder: str) -> DataFrame:
    left, pruned = corpus.prune(file_tree(spark, folder))
    events = corpus.coverage_events(corpus.decode(left, vocab.MAX_FILE_SIZE), pruned)
    return events.withColumn("source", F.split_part("path", F.lit("/"), F.lit(2)))


def pruned_dirs(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.prune(file_tree(spark, folder))[1]


def exclude_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Files a caller names are left out and accounted for."""
    files = file_tree(spark, folder)
    named = read_table(spark, folder, "labels").select("doc_id").join(files.select("doc_id", "path"), "doc_id").select("path")
    left, skipped = corpus.excluded(files, named)
    return left.select("path", F.lit("kept").alias("reason")).unionByName(skipped)


def coverage_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _tree_events(spark, folder).select("source", "kind", "path", "reason")


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    return sc.coverage_status(_tree_events(spark, folder), ["source"]).drop("holes")


def coverage_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return sc.coverage_by_reason(_tree_events(spark, folder), ["source"])


def coverage_words(spark: SparkSession, folder: str) -> DataFrame:
    return sc.unknown_reasons(_tree_events(spark, folder), ["source"])


# ------------------------------------------------------------------- findings
KEYS = ["source"]
IGNORED = {"rules": ["AS-005"], "servers": ["files"], "domains": ["curl", " PASSWORD "]}
SUPPRESS_SQL = (
    "CASE WHEN rule_id IN ('AS-005') THEN 'rule ' || rule_id || ' ignored' "
    "WHEN contains(description, '''files''') THEN 'MCP server ''files'' ignored' "
    "WHEN contains(lower(evidence), 'curl') OR contains(lower(evidence), 'password') THEN 'domain ignored' END"
)
MARKED_SQL = FINDINGS_SQL + f", marked AS (SELECT *, {SUPPRESS_SQL} AS suppression_reason, ({SUPPRESS_SQL}) IS NOT NULL AS suppressed FROM line_findings)"


def marked_findings(spark: SparkSession, folder: str) -> DataFrame:
    return en.suppress(seeded_findings(spark, folder), **IGNORED)


def suppression(spark: SparkSession, folder: str) -> DataFrame:
    return marked_findings(spark, folder).select("doc_id", "line", "rule", "suppressed", "suppression_reason")


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    rows = en.enrich(seeded_findings(spark, folder))
    return rows.select(
        "doc_id", "line", "rule", "confidence", "matched_text",
        F.array_join("cwe", ",").alias("cwe"),
        F.array_join(F.transform("mitre", lambda t: F.concat(t["id"], F.lit("="), t["name"])), ";").alias("mitre"),
    )


def _words(table: dict, render) -> str:
    return "CASE rule_id " + " ".join(f"WHEN {q(k)} THEN {q(render(v))}" for k, v in table.items()) + " ELSE '' END"


SHELL_HIT = " OR ".join(f"contains(evidence, {q(e)})" for e in vocab.UNIX_SHELL_EVIDENCE)
ENRICH_SQL = f"""WITH {FINDINGS_SQL} SELECT doc_id, line, rule,
  CASE WHEN rule_id IN ('AS-006', 'AS-007') OR (rule_id = 'AS-001' AND (contains(evidence, 'API credential detected')
    OR contains(evidence, 'Private key block'))) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
  CASE WHEN rule_id = 'AS-001' THEN evidence ELSE trim(text) END AS matched_text,
  {_words(vocab.CWE, lambda v: ','.join(v))} AS cwe,
  {_words(vocab.MITRE, lambda v: '='.join(v))} || CASE WHEN rule_id = 'AS-002' AND ({SHELL_HIT}) THEN {q(';' + '='.join(vocab.UNIX_SHELL))} ELSE '' END AS mitre
  FROM line_findings"""


def score_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return sc.scores(marked_findings(spark, folder), KEYS)


def score_by_document(spark: SparkSession, folder: str) -> DataFrame:
    return sc.scores(marked_findings(spark, folder), ["doc_id"])


WEIGHT = "CASE severity " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in vocab.SEVERITY_WEIGHT.items()) + " END"
RANK = "CASE severity " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in vocab.SEVERITY_RANK.items()) + " END"
LEVEL = "CASE " + " ".join(f"WHEN score >= {b} THEN {q(n)}" for b, n in vocab.RISK_BUCKETS) + " ELSE 'SAFE' END"


def score_sql(key: str) -> str:
    return (
        f"scored AS (SELECT {key}, CAST(least(sum(CASE WHEN suppressed THEN 0 ELSE {WEIGHT} END), 100) AS INTEGER) AS score FROM marked GROUP BY {key})"
    )


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return sc.severity_summary(marked_findings(spark, folder), KEYS)


def classes(spark: SparkSession, folder: str) -> DataFrame:
    return sc.finding_classes(marked_findings(spark, folder), KEYS, ["doc_id", "line", "rule_order"])


def exit_codes(spark: SparkSession, folder: str) -> DataFrame:
    return sc.gate(marked_findings(spark, folder), ["doc_id"], "HIGH")


def risk_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Score and coverage together: targets are languages of readable documents."""
    found = marked_findings(spark, folder)
    return sc.risk_with_coverage(
        sc.scores(found, KEYS), sc.coverage_status(_tree_events(spark, folder), KEYS), KEYS
    )


def risk_verdict_by_document(spark: SparkSession, folder: str) -> DataFrame:
    """One target per document, so that all levels and UNKNOWN occur."""
    files = file_tree(spark, folder)
    left, pruned = corpus.prune(files)
    events = corpus.coverage_events(corpus.decode(left, vocab.MAX_FILE_SIZE), pruned.where("false"))
    ids = files.select("path", "doc_id")
    per_doc = events.join(ids, "path")
    return sc.risk_with_coverage(
        sc.scores(marked_findings(spark, folder), ["doc_id"]), sc.coverage_status(per_doc, ["doc_id"]), ["doc_id"]
    )


def escaped(spark: SparkSession, folder: str) -> DataFrame:
    """Untrusted text made printable: page markup with control characters in it."""
    pages = read_table(spark, folder, "pages")
    raw = F.concat("url", F.lit("\\"), F.lit("\u001b[31m"), "html", F.lit("\u0085​ "))
    return pages.select("page_id", tx.escape_untrusted(raw).alias("shown"), F.length(tx.escape_untrusted(raw, None)).alias("n"))


def domains(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return pages.select("page_id", tx.url_host(F.concat(F.lit("see "), "url")).alias("domain"))


def redaction(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of secret rules never holds more than eight characters of the value."""
    found = seeded_findings(spark, folder).where("rule_id = 'AS-001'")
    return found.groupBy("evidence").agg(F.count("*").alias("n"))


QUERIES = {
    "admit_files": admission,
    "decode_files": decoded,
    "prune_dirs": pruned_dirs,
    "exclude_paths": exclude_paths,
    "coverage_events": coverage_rows,
    "coverage_status": coverage,
    "coverage_by_reason": coverage_reasons,
    "coverage_reasons_text": coverage_words,
    "suppress_findings": suppression,
    "enrich_findings": enriched,
    "redact_evidence": redaction,
    "score_by_source": score_by_source,
    "score_by_document": score_by_document,
    "severity_summary": summary,
    "finding_classes": classes,
    "exit_code_gate": exit_codes,
    "risk_with_coverage": risk_verdict,
    "risk_with_coverage_by_document": risk_verdict_by_document,
    "escape_untrusted": escaped,
    "extract_domain": domains,
}
TREE = f"WITH {TREE_SQL}"
STATUS = (
    "status AS (SELECT {key}, count(*) FILTER (kind IN ('scanned','decode_error')) AS files_scanned, "
    "CASE WHEN count(*) FILTER (kind IN ('scanned','decode_error')) = 0 THEN 'none' WHEN count(*) FILTER (kind IN ('skipped','decode_error') "
    "OR reason = 'vendored_dir') > 0 THEN 'partial' ELSE 'full' END AS coverage_status FROM {rows} GROUP BY {key})"
)
ESC = r"""list_transform(string_split(raw, ''), lambda c: CASE WHEN c = '\' THEN '\\' WHEN regexp_matches(c, '[\pC\pZ]') AND c <> ' '
  THEN CASE WHEN ord(c) <= 255 THEN '\x' || lower(lpad(hex(ord(c)), 2, '0')) WHEN ord(c) <= 65535 THEN '\u' || lower(lpad(hex(ord(c)), 4, '0'))
  ELSE '\U' || lower(lpad(hex(ord(c)), 8, '0')) END ELSE c END)"""
ORACLES = {
    "admit_files": f"{TREE} SELECT path, length, coalesce(skip_reason, 'read') AS verdict FROM judged",
    "decode_files": f"{TREE} SELECT path, variant = 2 AS lossy, md5(CASE WHEN variant = 2 THEN text || chr(65533) ELSE text END) AS text_hash FROM judged WHERE skip_reason IS NULL",
    "prune_dirs": f"{TREE} SELECT path, reason FROM events_of WHERE kind = 'pruned'",
    "exclude_paths": f"{TREE} SELECT path, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'baseline_snapshot' ELSE 'kept' END AS reason FROM tree",
    "coverage_events": f"{TREE} SELECT source, kind, path, reason FROM events_of",
    "coverage_status": f"{TREE}, {STATUS.format(key='source', rows='events_of')} SELECT * FROM status",
    "coverage_by_reason": f"{TREE} SELECT source, kind, reason, count(*) AS n FROM events_of GROUP BY ALL",
    "coverage_reasons_text": f"""{TREE} SELECT source, coalesce(nullif(concat_ws(', ', CASE WHEN a > 0 THEN a || ' skipped files' END,
        CASE WHEN b > 0 THEN b || ' lossy files' END, CASE WHEN d > 0 THEN d || ' vendored dirs not entered' END), ''), 'nothing was read') AS reasons
        FROM (SELECT source, count(*) FILTER (kind = 'skipped') a, count(*) FILTER (kind = 'decode_error') b,
        count(*) FILTER (reason = 'vendored_dir') d FROM events_of GROUP BY source)""",
    "suppress_findings": f"WITH {MARKED_SQL} SELECT doc_id, line, rule, suppressed, suppression_reason FROM marked",
    "enrich_findings": ENRICH_SQL,
    "redact_evidence": f"WITH {FINDINGS_SQL} SELECT evidence, count(*) AS n FROM line_findings WHERE rule_id = 'AS-001' GROUP BY evidence",
    "score_by_source": f"WITH {MARKED_SQL}, {score_sql('source')} SELECT source, score, {LEVEL} AS risk_level FROM scored",
    "score_by_document": f"WITH {MARKED_SQL}, {score_sql('doc_id')} SELECT doc_id, score, {LEVEL} AS risk_level FROM scored",
    "severity_summary": f"WITH {MARKED_SQL} SELECT source, "
    + ", ".join(f"count(*) FILTER (NOT suppressed AND severity = {q(s)}) AS {s.lower()}" for s in vocab.SEVERITIES[:4])
    + ", count(*) FILTER (suppressed) AS suppressed FROM marked GROUP BY source",
    "finding_classes": f"""WITH {MARKED_SQL} SELECT source, rule_id, count(*) AS n,
        CASE max({RANK}) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'INFO' END AS severity,
        arg_min(title, (doc_id, line, rule_order)) AS title FROM marked WHERE NOT suppressed GROUP BY source, rule_id""",
    "exit_code_gate": f"""WITH {MARKED_SQL} SELECT doc_id, CASE WHEN max(CASE WHEN NOT suppressed THEN {RANK} END) >= 4 THEN 2
        WHEN max(CASE WHEN NOT suppressed THEN {RANK} END) >= 3 THEN 1 ELSE 0 END AS exit_code FROM marked GROUP BY doc_id""",
    "risk_with_coverage": f"""WITH {MARKED_SQL}, {score_sql('source')}, {TREE_SQL}, {STATUS.format(key='source', rows='events_of')}
        SELECT source, coalesce(score, 0) AS score, coalesce(coverage_status, 'none') AS coverage_status,
        CASE WHEN coalesce(score, 0) < 5 AND coalesce(coverage_status, 'none') <> 'full' THEN 'UNKNOWN' ELSE {LEVEL} END AS risk_level
        FROM status FULL JOIN scored USING (source)""",
    "risk_with_coverage_by_document": f"""WITH {MARKED_SQL}, {score_sql('doc_id')}, {TREE_SQL},
        per_doc AS (SELECT doc_id, kind, reason FROM events_of JOIN judged USING (path)), {STATUS.format(key='doc_id', rows='per_doc')}
        SELECT doc_id, coalesce(score, 0) AS score, coalesce(coverage_status, 'none') AS coverage_status,
        CASE WHEN coalesce(score, 0) < 5 AND coalesce(coverage_status, 'none') <> 'full' THEN 'UNKNOWN' ELSE {LEVEL} END AS risk_level
        FROM status FULL JOIN scored USING (doc_id)""",
    "escape_untrusted": f"""SELECT page_id, CASE WHEN length(t) > 500 THEN left(t, 500) || ' [truncated]' ELSE t END AS shown, CAST(length(t) AS INTEGER) AS n
        FROM (SELECT page_id, array_to_string({ESC}, '') AS t FROM (SELECT page_id, url || '\\' || chr(27) || '[31m' || html || chr(133) || chr(8203) || chr(160) AS raw FROM pages))""",
    "extract_domain": "SELECT page_id, nullif(lower(regexp_extract('see ' || url, 'https?://([^/\\s''\"]+)', 1)), '') AS domain FROM pages",
}
