"""Steps, actions and chains: over the seeded corpus and over events read as actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators import correlate as co
from wardlight.operators import steps as st
from wardlight.plans import carriers
from wardlight.plans.carriers import ACTIONS_SQL, LINES_SQL
from wardlight.plans.q_rules import FINDINGS_SQL, seeded_findings
from wardlight.plans.sqltext import array, m, names, q
from wardlight.session import cut

DOC = ["doc_id"]
COMPONENT = ["component"]
ORDER = ["line", "rule_order"]


def seeded_actions(spark: SparkSession, folder: str) -> DataFrame:
    return st.actions(carriers.seeded_lines(spark, folder).select("doc_id", "source", "path", "line", "text"))


def split_segments(spark: SparkSession, folder: str) -> DataFrame:
    lines = carriers.seeded_lines(spark, folder).select("doc_id", "line", "text")
    return st.split_actions(lines).select("doc_id", "line", "seg", F.md5("part").alias("part_hash"))


def step_categories(spark: SparkSession, folder: str) -> DataFrame:
    lines = carriers.seeded_lines(spark, folder).select("doc_id", "line", "text")
    rows = st.classified(st.split_actions(lines))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def extract_actions(spark: SparkSession, folder: str) -> DataFrame:
    return seeded_actions(spark, folder).select("doc_id", *st.ACTION_COLUMNS)


def normalized_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Object normalisation over part names and types in several dressings."""
    part = carriers.read_table(spark, folder, "part")
    phrase = F.concat(F.lit("The  local "), "p_name", F.lit(", "), "p_type", F.lit(" data  FILE contents."))
    return part.select("p_partkey", st.normalize_object(phrase).alias("object"), st.normalize_object(F.concat(F.lit("the data content "), F.lit("report"))).alias("rest"))


def stripped_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = carriers.read_table(spark, folder, "pages")
    return pages.select("page_id", tx.strip_url_tail(F.concat("url", F.lit(".)!?\"'"))).alias("url"))


def _span(find, steps, keys):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return find(steps(spark, folder), keys)

    return run


def _sequence(steps: DataFrame, keys) -> DataFrame:
    return st.find_sequence(steps, keys, ["SOURCE", "SENSITIVE", "NETWORK"])


def document_chains(spark: SparkSession, folder: str) -> DataFrame:
    return st.file_chains(cut(seeded_actions(spark, folder)), DOC).select("doc_id", "rule_id", "severity", "title", "evidence", "first", "last")


# ------------------------------------------------------------------ SQL twins
def _case(pairs, column: str) -> str:
    return "CASE " + " ".join(f"WHEN {m(column, p, True)} THEN {q(n)}" for n, p in pairs) + " END"


def _normal(expr: str) -> str:
    plain = f"regexp_replace(lower(trim({expr})), '[^a-z0-9\\s./_-]', '', 'g')"
    plain = f"trim(rtrim(trim(regexp_replace({plain}, '\\s+', ' ', 'g')), '.'))"
    lead = "|".join(vocab.MODIFIERS)
    tail = "|".join(vocab.CONTAINERS)
    plain = f"regexp_replace({plain}, {q(f'^(?:(?:{lead})(?: |$))+')}, '')"
    return f"regexp_replace({plain}, {q(f'([^ ])(?: (?:{tail}))+$')}, '\\1')"


SEGMENTS_SQL = LINES_SQL + f""", pieces AS (
  SELECT doc_id, source, path, line, i, trim(regexp_replace(trim(p[i]), '(?i)^(?:and\\s+then|then)\\s+', '')) AS part
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT *, string_split_regex(text, {q('(?i)' + vocab.ACTION_SEPARATOR)}) AS p FROM lines))),
segments AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, line ORDER BY i) - 1 AS INTEGER) AS seg FROM pieces WHERE part <> ''),
stepped AS (SELECT *, {_case(vocab.STEP_PATTERNS, 'part')} AS category FROM segments),
spoken AS (SELECT *, lower(regexp_extract(part, '^\\s*([A-Za-z]+)', 1)) AS verb FROM stepped WHERE category IS NOT NULL),
resting AS (SELECT *, trim(substr(part, length(verb) + 1)) AS rest FROM spoken),
steps AS (SELECT doc_id, source, path, CAST(line AS BIGINT) * 4294967296 + seg AS idx, line, category, verb,
    {_normal(f"string_split_regex(rest, {q('(?i)' + vocab.OBJECT_END)})[1]")} AS object,
    nullif(rtrim(regexp_extract(part, 'https?://[^\\s''"]+'), '.,;:!?)]}}"'''), '') AS destination,
    CASE WHEN category = 'TRANSFORM' AND regexp_extract(rest, '(?i)\\b(?:into|to)\\s+(.+)$', 1) <> '' THEN {_normal("regexp_extract(rest, '(?i)\\b(?:into|to)\\s+(.+)$', 1)")} END AS output
  FROM resting)"""


def sequence_sql(table: str, key: str) -> str:
    return f"""two AS (SELECT a.{key}, a.idx AS idx1, a.line AS line1, min(b.idx) AS idx2, arg_min(b.line, b.idx) AS line2
    FROM {table} a JOIN {table} b ON a.{key} = b.{key} AND a.idx < b.idx WHERE a.category = 'SOURCE' AND b.category = 'SENSITIVE' GROUP BY ALL),
  three AS (SELECT t.*, min(c.idx) AS idx3, arg_min(c.line, c.idx) AS line3 FROM two t JOIN {table} c ON t.{key} = c.{key} AND c.idx > t.idx2
    WHERE c.category = 'NETWORK' GROUP BY ALL),
  exfil AS (SELECT {key}, unnest(arg_min({{'idx1': idx1, 'line1': line1, 'idx2': idx2, 'line2': line2, 'idx3': idx3, 'line3': line3}}, idx1))
    FROM three WHERE line3 - line1 <= {vocab.LINE_SPAN} GROUP BY {key})"""


def _words(expr: str) -> str:
    dull = array(vocab.STOPWORDS + vocab.ACTION_WORDS)
    return f"list_filter(string_split({expr}, ' '), lambda w: length(w) >= {vocab.MIN_OBJECT_WORD} AND NOT list_contains({dull}, w))"


def fetch_sql(table: str, key: str) -> str:
    return f"""exe AS (SELECT *, {_words("trim(object, ' .')")} AS words FROM {table} WHERE category = 'EXECUTION'),
  fetched AS (SELECT {key}, unnest(min({{'idx1': d.idx, 'line1': d.line, 'idx2': e.idx, 'line2': e.line}}))
    FROM (SELECT * FROM {table} WHERE category = 'DOWNLOAD') d JOIN exe e USING ({key})
    WHERE e.idx > d.idx AND e.line - d.line <= {vocab.LINE_SPAN} AND (trim(e.object, ' .') IN {names(vocab.ANAPHORA)}
      OR (len(e.words) BETWEEN 1 AND {vocab.MAX_EXEC_WORDS} AND (len(list_filter(e.words, lambda w: contains(d.object, w))) > 0
        OR len(list_filter(e.words, lambda w: NOT list_contains({array(vocab.ARTEFACT_KINDS)}, w))) = 0)))
    GROUP BY {key})"""


def sink_sql(table: str, key: str) -> str:
    return f"""made AS (SELECT {key}, object, min(idx) AS ready, arg_min(line, idx) AS made_at FROM {table}
    WHERE category IN ('SOURCE', 'SENSITIVE') AND object <> '' GROUP BY ALL),
  reach AS (SELECT {key}, idx AS sink, object FROM {table} WHERE category = 'NETWORK' AND object <> '' AND destination IS NOT NULL
    UNION SELECT r.{key}, r.sink, t.object FROM reach r JOIN {table} t ON t.{key} = r.{key} AND t.output = r.object
      AND t.category = 'TRANSFORM' AND t.object <> '' AND t.output <> '' AND t.idx < r.sink),
  fits AS (SELECT {key}, sink, min(made_at) AS first_line FROM reach JOIN made USING ({key}, object) WHERE ready < sink GROUP BY ALL),
  chosen AS (SELECT {key}, min(sink) AS sink, arg_min(first_line, sink) AS first_line FROM fits GROUP BY {key}),
  sunk AS (SELECT {key}, s.object, c.sink AS sink_idx, s.line AS last_line, c.first_line FROM chosen c JOIN {table} s USING ({key}) WHERE s.idx = c.sink)"""


CHAIN_ROWS = f"""SELECT doc_id, 'AS-CHAIN-001' AS rule_id, 'CRITICAL' AS severity, 'Potential secret exfiltration chain' AS title,
    {q(st.evidence_of(['SOURCE', 'SENSITIVE', 'NETWORK']))} AS evidence, line1 AS "first", line3 AS "last" FROM exfil
  UNION ALL SELECT doc_id, 'AS-CHAIN-002', 'CRITICAL', 'Remote download followed by execution', {q(st.evidence_of(['DOWNLOAD', 'EXECUTION']))}, line1, line2 FROM fetched
  UNION ALL SELECT doc_id, 'AS-CHAIN-004', 'CRITICAL', 'Potential data exfiltration chain (source-to-sink)',
    'Source-to-sink: ' || object || ' -> external destination', first_line, last_line FROM sunk"""
CHAINS_SQL = (
    f"{SEGMENTS_SQL}, {sequence_sql('steps', 'doc_id')}, {fetch_sql('steps', 'doc_id')}, {sink_sql('steps', 'doc_id')}, chains AS ({CHAIN_ROWS})"
)


# ---------------------------------------------------------------- correlation
def _found(spark: SparkSession, folder: str) -> DataFrame:
    return seeded_findings(spark, folder).select("source", "doc_id", "path", "line", "rule_order", "rule_id", "severity")


def triples(spark: SparkSession, folder: str) -> DataFrame:
    best = co.secret_exfiltration(cut(_found(spark, folder)), ["path"], ORDER)
    return best.select(
        "path", *[F.concat_ws(":", f"{x}.line", f"{x}.rule_order").alias(x) for x in ("a", "b", "c")]
    )


def download_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return co.download_execute(cut(_found(spark, folder)), ["path"]).select("path", "line", "rule_order", "side")


def unplaced_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Downloads next to commands, when the commands of every fourth document have no line: findings per file and side."""
    bare = (F.col("doc_id") % 4 == 0) & (F.col("rule_id") == "AS-002")
    found = _found(spark, folder).withColumn("line", F.when(~bare, F.col("line")))
    return co.download_execute(cut(found), ["path"]).groupBy("path", "side").agg(F.count("*").alias("n"), F.count_if(F.col("line").isNull()).alias("unplaced"))


def chain_parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = co.contributors(_found(spark, folder), ["source"], "path", ORDER)
    return parts.select("source", "path", "chain", "rule_id", "severity", "line")


def correlated(spark: SparkSession, folder: str) -> DataFrame:
    parts = cut(co.contributors(_found(spark, folder), ["source"], "path", ORDER))
    return co.chain_findings(parts, ["source"], "path").select("source", "rule_id", "severity", "title", "file", "evidence")


def uncovered_chains(spark: SparkSession, folder: str) -> DataFrame:
    chains = cut(st.file_chains(cut(seeded_actions(spark, folder)), ["source", "path"]))
    parts = cut(co.contributors(_found(spark, folder), ["source"], "path", ORDER))
    return co.uncovered(chains, parts, ["source"], "path").select("path", "rule_id", "first", "last")


TRIPLE_SQL = f"""f AS (SELECT *, struct_pack(line := line, rule_order := rule_order) AS ord FROM line_findings),
triple AS (SELECT path, unnest(min(struct_pack(tier := CASE WHEN a.ord = b.ord THEN 1 ELSE 0 END, a := a.ord, b := b.ord, c := c.ord)))
  FROM (SELECT * FROM f WHERE rule_id = 'AS-004') a JOIN (SELECT * FROM f WHERE rule_id IN ('AS-001', 'AS-004')) b USING (path)
  JOIN (SELECT * FROM f WHERE rule_id IN ('AS-003', 'AS-005')) c USING (path)
  WHERE greatest(a.line, b.line, c.line) - least(a.line, b.line, c.line) <= {vocab.LINE_SPAN} GROUP BY path),
pairs AS (SELECT d.path, d.line AS dl, d.rule_order AS dr, e.line AS el, e.rule_order AS er
  FROM (SELECT * FROM f WHERE rule_id IN ('AS-003', 'AS-005')) d JOIN (SELECT * FROM f WHERE rule_id = 'AS-002') e
  ON d.path = e.path AND abs(d.line - e.line) <= {vocab.LINE_SPAN}),
sides AS (SELECT DISTINCT path, dl AS line, dr AS rule_order, 'download' AS side FROM pairs
  UNION ALL SELECT DISTINCT path, el, er, 'execution' FROM pairs),
parts AS (SELECT source, f.path, 'AS-CHAIN-001' AS chain, rule_id, severity, line FROM f
    WHERE (path, ord) IN (SELECT path, a FROM triple UNION SELECT path, b FROM triple UNION SELECT path, c FROM triple)
  UNION ALL SELECT source, f.path, 'AS-CHAIN-002', rule_id, severity, f.line FROM f JOIN sides s ON f.path = s.path AND f.line = s.line AND f.rule_order = s.rule_order)"""
PARTS = f"WITH {FINDINGS_SQL}, {TRIPLE_SQL}"
HIGH = "severity IN ('CRITICAL', 'HIGH')"

QUERIES = {
    "split_actions": split_segments,
    "classify_steps": step_categories,
    "extract_actions": extract_actions,
    "normalize_object": normalized_objects,
    "strip_url_punctuation": stripped_urls,
    "step_sequence_text": _span(_sequence, seeded_actions, DOC),
    "step_sequence_events": _span(_sequence, carriers.action_stream, COMPONENT),
    "download_execute_text": _span(st.find_download_execute, seeded_actions, DOC),
    "download_execute_events": _span(st.find_download_execute, carriers.action_stream, COMPONENT),
    "source_sink_text": _span(st.find_source_sink, seeded_actions, DOC),
    "source_sink_events": _span(st.find_source_sink, carriers.action_stream, COMPONENT),
    "document_chains": document_chains,
    "correlate_secret_exfiltration": triples,
    "correlate_download_execute": download_pairs,
    "correlate_unplaced": unplaced_pairs,
    "chain_contributors": chain_parts,
    "correlated_chains": correlated,
    "uncovered_chains": uncovered_chains,
}
EVENT = f"WITH RECURSIVE {ACTIONS_SQL}"
TEXT = f"WITH RECURSIVE {SEGMENTS_SQL}"
ORACLES = {
    "split_actions": f"{TEXT} SELECT doc_id, line, seg, md5(part) AS part_hash FROM segments",
    "classify_steps": f"{TEXT} SELECT category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM stepped WHERE category IS NOT NULL GROUP BY category",
    "extract_actions": f"{TEXT} SELECT doc_id, idx, line, category, verb, object, destination, output FROM steps",
    "normalize_object": "SELECT p_partkey, " + _normal("'The  local ' || p_name || ', ' || p_type || ' data  FILE contents.'") + " AS object, 'data' AS rest FROM part",
    "strip_url_punctuation": "SELECT page_id, rtrim(url || '.)!?\"''', '.,;:!?)]}\"''') AS url FROM pages",
    "step_sequence_text": f"{TEXT}, {sequence_sql('steps', 'doc_id')} SELECT * FROM exfil",
    "step_sequence_events": f"{EVENT}, {sequence_sql('actions', 'component')} SELECT * FROM exfil",
    "download_execute_text": f"{TEXT}, {fetch_sql('steps', 'doc_id')} SELECT * FROM fetched",
    "download_execute_events": f"{EVENT}, {fetch_sql('actions', 'component')} SELECT * FROM fetched",
    "source_sink_text": f"{TEXT}, {sink_sql('steps', 'doc_id')} SELECT * FROM sunk",
    "source_sink_events": f"{EVENT}, {sink_sql('actions', 'component')} SELECT * FROM sunk",
    "document_chains": f"WITH RECURSIVE {CHAINS_SQL} SELECT * FROM chains",
    "correlate_secret_exfiltration": f"{PARTS} SELECT path, a.line || ':' || a.rule_order AS a, b.line || ':' || b.rule_order AS b, c.line || ':' || c.rule_order AS c FROM triple",
    "correlate_download_execute": f"{PARTS} SELECT path, line, rule_order, side FROM sides",
    "correlate_unplaced": f"""WITH {FINDINGS_SQL}, f AS (SELECT path, rule_id, CASE WHEN doc_id % 4 = 0 AND rule_id = 'AS-002' THEN NULL ELSE line END AS line, row_number() OVER (ORDER BY doc_id, line, rule_order) AS id FROM line_findings),
        met AS (SELECT d.path, d.id AS did, d.line AS dl, e.id AS eid, e.line AS el FROM (SELECT * FROM f WHERE rule_id IN ('AS-003', 'AS-005')) d JOIN (SELECT * FROM f WHERE rule_id = 'AS-002') e
          ON d.path = e.path AND (d.line IS NULL OR e.line IS NULL OR abs(d.line - e.line) <= {vocab.LINE_SPAN}))
        SELECT path, side, count(*) AS n, count(*) FILTER (line IS NULL) AS unplaced FROM (SELECT DISTINCT path, 'download' AS side, did AS id, dl AS line FROM met UNION ALL SELECT DISTINCT path, 'execution', eid, el FROM met) GROUP BY path, side""",
    "chain_contributors": f"{PARTS} SELECT * FROM parts",
    "correlated_chains": f"""{PARTS} SELECT source, chain AS rule_id,
        CASE WHEN chain = 'AS-CHAIN-001' OR (bool_or({HIGH} AND rule_id IN ('AS-003','AS-005')) AND bool_or({HIGH} AND rule_id = 'AS-002')) THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
        CASE chain WHEN 'AS-CHAIN-001' THEN 'Potential secret exfiltration chain' ELSE 'Remote download followed by execution' END AS title,
        '<correlated>' AS file, CASE chain WHEN 'AS-CHAIN-001' THEN {q(co.CHAINS['AS-CHAIN-001'][1])} ELSE {q(co.CHAINS['AS-CHAIN-002'][1])} END
          || array_to_string(list_sort(list_distinct(list(path || ':' || line))), ', ') AS evidence
        FROM parts GROUP BY source, chain""",
    "uncovered_chains": f"""WITH RECURSIVE {CHAINS_SQL}, {FINDINGS_SQL[FINDINGS_SQL.index('line_findings AS ('):]}, {TRIPLE_SQL}
        SELECT path, rule_id, "first", "last" FROM (SELECT c.*, d.path FROM chains c JOIN docs d USING (doc_id)) x
        WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.path = x.path AND p.chain = x.rule_id AND p.line BETWEEN x."first" AND x."last")""",
}
