"""Line rules over the seeded corpus: one query per rule, the whole pass, and the scores built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import line_rules as lr
from wardlight.operators import rule_catalog as rc
from wardlight.plans import carriers
from wardlight.plans.carriers import LINES_SQL
from wardlight.sources.corpus import explode_lines, read_texts
from wardlight.plans.sqltext import (
    array, every, lead, live, m, plain_regex, q, quoted_mention, tail, vocabulary_row,
)

SHOWN = ["doc_id", "path", "line", "rule_id", "severity", "evidence"]


def _rule_query(rule: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        lines = carriers.seeded_lines(spark, folder).select("doc_id", "path", "line", "text")
        return lr.line_findings(lines, lr.pick_rules([rule])).select(*SHOWN)

    return run


# ------------------------------------------------------------- SQL conditions
T = "text"
COMMENT = f"NOT {m(T, rc.COMMENT_LINE)}"
LOCAL_IP = r"^(?:127(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}|0\.0\.0\.0)$"
CALL = r"\b(?:requests|httpx|aiohttp)(?:\.[A-Za-z_]\w*)*\s*\("
OTHER = rc.HTTP_OTHER_CALL.replace(r"(?<![.\w`])(?<!def )(?<!function )fetch\(", r"(?:def |function |[^.\w`\x22]|^)fetch\(")
LIVE_CLIENT = (
    f"len(list_filter({live(f'{rc.HTTP_FROM_IMPORT}|{CALL}|{rc.HTTP_DECLARATION}|{OTHER}')}, lambda t: NOT ("
    f"starts_with(t, 'def ') OR starts_with(t, 'function ') "
    f"OR {m('t', rf'^(?:requests|httpx|aiohttp)(?:\.\w+)*\.(?:{rc.HTTP_VALUE_CLASSES})\b[\w.]*\s*\($')} "
    f"OR ({m('t', '^' + rc.HTTP_FROM_IMPORT[2:])} AND len(list_filter(list_transform(string_split("
    f"regexp_extract(t, {q(plain_regex('^' + rc.HTTP_FROM_IMPORT[2:]))}, 1), ','), lambda n: trim(regexp_replace(n, '\\s+as\\s+\\w+', '', 'g'))), "
    f"lambda n: n <> '' AND NOT list_contains({array(rc.HTTP_VALUE_NAMES)}, n))) = 0)))) > 0"
)
LIVE_OBJECT = f"len({live(rc.HTTP_OBJECT_CALL, fold=True)}) > 0"
VERB = r"(?:^|[^\w-])(?:{verbs})(?:[^\w-].{{0,119}})?$"


def _clause(prefix: str) -> str:
    return f"list_last(string_split_regex({prefix}, {q('(?i)' + rc.CLAUSE_BREAK)}))"


PATH = rc.SENSITIVE_PATH.replace(r"\.env(?!\.?\w|\()", r"\.env(?:$|\.$|\.[^\w]|[^\w.(])").replace(
    r"\.pem(?![\w(])|\.key(?![\w(])", r"\.pem(?:$|[^\w(])|\.key(?:$|[^\w(])"
)
NO_PROCESS = f"regexp_replace(text, {q('(?i)' + rc.PROCESS_ENV)}, '\\1_\\2', 'g')"
STEMS = "(" + " OR ".join(f"contains(lower(text), {q(s)})" for s in rc.CREDENTIAL_STEMS) + ")"
READS_PATH = (
    f"({STEMS} AND NOT {m(T, rc.ACCESS_NEGATION, True)} AND {m(NO_PROCESS, PATH, True)} AND "
    f"{m(_clause(lead(NO_PROCESS, PATH)), VERB.format(verbs=rc.ACCESS_VERBS), True)})"
)
CONFIG_LEAD = lead(T, rc.CONFIG_OBJECT)
READS_CONFIG = (
    f"({STEMS} AND NOT {m(T, rc.ACCESS_NEGATION, True)} AND {m(T, rc.CONFIG_OBJECT, True)} AND "
    f"{m(_clause(CONFIG_LEAD), VERB.format(verbs=rc.CONFIG_VERBS), True)} AND {m(T, rc.CREDENTIAL_TERM, True)} "
    f"AND NOT {m(CONFIG_LEAD, rc.ADVISORY, True)})"
)
SPAN = plain_regex(rc.QUOTED_SPAN)
TABLE_ROW = (
    f"(starts_with(trim(text), '(') AND ends_with(trim(text), '),') AND len({every(T, SPAN)}) >= 3 AND "
    f"{m(f'list_filter({every(T, SPAN + chr(124) + rc.OS_SYSTEM)}, lambda t: {m('t', rc.OS_SYSTEM)})[1]', '^[\\x22\\x27]')})"
)
REGEX_EXEC = (
    r"(?:/(?:[^/\\\n]|\\.)+/[gimsuyd]*\?*\s*|(^|[^\w$])(?i:(?:[A-Za-z_$][\w$]*_|_)?(?:re|regex|regexp|pattern|matcher)"
    r"|rex|rgx|regexobj)\s*\?*\s*)\.\s*exec\(\s*[a-zA-Z_][a-zA-Z0-9_]*\s*\)"
)
EVALS = m(f"regexp_replace(text, {q(REGEX_EXEC)}, '\\1 ', 'g')", rc.EVAL_EXEC)
JS_CALL = (
    r"(?:\bchild_process\s*\.\s*(?:exec|execSync|spawn|spawnSync)\s*\(|(?:^|[^\w.])(?:exec|execSync|spawn|spawnSync)\()"
)
JS_EXEC = (
    f"({m(T, JS_CALL + r'\s*(?:[rubfRUBF]*[\x22\x27`]|\w+\s*[,)])')} AND NOT {m(T, JS_CALL + r'[^)]*\)\s*(?:=>|\{)')})"
)
OPENAI = r"\bsk-(?:[A-Zb-z0-9_-]|a[A-Za-mo-z0-9_-]|an[A-Za-su-z0-9_-]|ant[A-Za-z0-9_])[A-Za-z0-9_-]{16,}"


def _cover(value: str) -> str:
    return f"left({value}, 8) || '***…'"


def _provider(pattern: str) -> str:
    return f"'API credential detected: ' || {_cover(f'regexp_extract(text, {q(plain_regex(pattern))})')}"


def _filler(value: str) -> str:
    rest = f"regexp_extract({value}, '^[^_]*_(.*)$', 1)"
    return f"(length({rest}) >= 8 AND replace({rest}, left({rest}, 1), '') = '')"


REAL_TOKENS = f"list_filter({every(T, rc.GITHUB_TOKEN)}, lambda t: NOT {_filler('t')})"
PAIRS = (
    f"list_zip({every(T, rc.GENERIC_SECRET, 1, True)}, {every(T, rc.GENERIC_SECRET, 2, True)})"
)
REAL_SECRETS = (
    f"list_filter({PAIRS}, lambda p: NOT (p[2] <> '' OR list_contains({array(rc.ACCESSOR_ROOTS)}, string_split(lower(p[1]), '.')[1]) "
    f"OR {m('lower(p[1])', rc.TEMPLATE_FRAGMENTS)} OR {_filler('lower(p[1])')} "
    f"OR len(list_filter(string_split_regex(lower(p[1]), '[-_.]'), lambda w: NOT (w = '' OR list_contains({array(rc.PLACEHOLDER_WORDS)}, w) "
    f"OR replace(w, left(w, 1), '') = ''))) = 0))"
)
PASSWORDS = f"list_filter({every(T, rc.PASSWORD_LITERAL, 1, True)}, lambda p: NOT {m('p', rc.MASK_ONLY)})"


def _spoken(pattern: str, negation: bool = False) -> str:
    cond = f"{m(T, pattern, True)} AND NOT {quoted_mention()} AND NOT {vocabulary_row()}"
    return cond + (f" AND NOT {m('pre', rc.REVEAL_NEGATION, True)}" if negation else "")


SPOKEN = {
    "ignore_instructions": rc.IGNORE_INSTRUCTIONS,
    "reveal_secrets": rc.REVEAL_SECRETS,
    "send_files": rc.SEND_FILES,
    "disable_security": rc.DISABLE_SECURITY,
}
CONDITION = {
    "raw_ip": f"len(list_filter({every(T, rc.RAW_IP, 1)}, lambda ip: NOT {m('ip', LOCAL_IP)})) > 0",
    "shortener": m(T, rc.SHORTENERS, True),
    "executable_url": f"len(list_filter({every(T, rc.EXECUTABLE_URL, 0, True)}, lambda u: {m('rtrim(regexp_extract(u, ' + q('(?i)^https?://[^/?#]*([^?#]*)') + ', 1), ' + q('/') + ')', rc.EXECUTABLE_EXT, True)})) > 0",
    "url_pipe_shell": m(T, rc.URL_PIPE_SHELL, True),
    "http_client": f"({LIVE_CLIENT} OR {LIVE_OBJECT})",
    "download_execute": m(T, rc.DOWNLOAD_EXECUTE),
    "ignore_instructions": _spoken(rc.IGNORE_INSTRUCTIONS),
    "reveal_secrets": _spoken(rc.REVEAL_SECRETS, True),
    "send_files": _spoken(rc.SEND_FILES),
    "disable_security": _spoken(rc.DISABLE_SECURITY),
    "encoded_directive": " OR ".join(
        f"({m(T, p, True)} AND NOT {m(lead(T, p), rc.REVEAL_NEGATION, True)})"
        for p in (rc.DECODE_DIRECTIVE, rc.DECODE_PIPE_SHELL)
    ),
    "unrelated_exec": m(T, rc.UNRELATED_EXEC, True),
    "openai_key": m(T, OPENAI),
    "anthropic_key": m(T, rc.ANTHROPIC_KEY),
    "github_token": f"len({REAL_TOKENS}) > 0",
    "aws_key_id": m(T, rc.AWS_KEY_ID),
    "generic_secret": f"len({REAL_SECRETS}) > 0",
    "password_literal": f"len({PASSWORDS}) > 0",
    "private_key": m(T, rc.PRIVATE_KEY),
    "sensitive_path": READS_PATH,
    "config_credential": f"{READS_CONFIG} AND NOT {READS_PATH}",
    "subprocess_shell": f"{m(T, rc.SUBPROCESS_SHELL)} AND {COMMENT}",
    "os_system": f"{m(T, rc.OS_SYSTEM)} AND {COMMENT} AND NOT coalesce({TABLE_ROW}, false)",
    "eval_exec": EVALS,
    "dynamic_code": f"{m(T, rc.DYNAMIC_CODE)} AND NOT {EVALS}",
    "command_from_var": m(T, rc.COMMAND_FROM_VAR),
    "js_shell": m(T, rc.JS_SHELL_TRUE),
    "js_exec": f"{JS_EXEC} AND NOT {m(T, rc.JS_SHELL_TRUE)}",
    "curl_pipe_shell": f"{m(T, rc.CURL_PIPE_SHELL)} AND {COMMENT}",
    "wget_pipe_shell": f"{m(T, rc.WGET_PIPE_SHELL)} AND {COMMENT}",
    "shell_eval": m(T, rc.SHELL_EVAL),
}
EVIDENCE = {
    "openai_key": _provider(OPENAI),
    "anthropic_key": _provider(rc.ANTHROPIC_KEY),
    "github_token": f"'API credential detected: ' || {_cover(REAL_TOKENS + '[1]')}",
    "aws_key_id": _provider(rc.AWS_KEY_ID),
    "generic_secret": f"'Credential detected: ' || {_cover(REAL_SECRETS + '[1][1]')}",
    "password_literal": f"'Password detected: ' || {_cover(PASSWORDS + '[1]')}",
}
CATALOG = {row[0]: row for row in rc.LINE_RULES}


def rule_select(rule: str) -> str:
    """SELECT over the CTE ``lines`` that yields the findings of one rule."""
    row = CATALOG[rule]
    source = "lines"
    if rule in SPOKEN:
        p = SPOKEN[rule]
        source = f"(SELECT *, {lead(T, p)} AS pre, {tail(T, p)} AS suf FROM lines WHERE {m(T, p, True)})"
    return (
        f"SELECT doc_id, source, path, line, text, {rc.RULE_ORDER[rule]} AS rule_order, {q(rule)} AS rule, {q(row[1])} AS rule_id, "
        f"{q(row[2])} AS severity, {q(row[3])} AS title, {EVIDENCE.get(rule, q(row[4]))} AS evidence, {q(row[5])} AS description "
        f"FROM {source} WHERE {CONDITION[rule]}"
    )


FINDINGS_SQL = LINES_SQL + ", line_findings AS (" + " UNION ALL ".join(rule_select(r) for r in CATALOG) + ")"


def seeded_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Every line finding of the seeded corpus."""
    return lr.line_findings(carriers.seeded_lines(spark, folder))


def line_pass(spark: SparkSession, folder: str) -> DataFrame:
    found = seeded_findings(spark, folder)
    return found.select(*SHOWN, "rule", "title", "matched_text")


def line_pass_by_text(spark: SparkSession, folder: str) -> DataFrame:
    lines = carriers.seeded_lines(spark, folder).select("doc_id", "path", "line", "text")
    return lr.line_findings_by_text(lines).select(*SHOWN, "rule", "title", "matched_text")


PASS_SQL = (
    f"WITH {FINDINGS_SQL} SELECT doc_id, path, line, rule_id, severity, evidence, rule, title, "
    "CASE WHEN rule_id = 'AS-001' THEN evidence ELSE trim(text) END AS matched_text FROM line_findings"
)


def lines_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return carriers.seeded_lines(spark, folder).select("doc_id", "line", F.md5("text").alias("text_hash"))


def lines_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_texts(spark, folder, "pages", "page_id", "html").select("page_id", F.col("html").alias("text"))
    return explode_lines(pages).groupBy("page_id").agg(
        F.count("*").alias("n_lines"), F.max("line").alias("last_line"), F.sum(F.length("text")).alias("n_chars")
    )


def plain_scan(kind: str):
    """The rules over a given table: documents just as they are, pages and turns with a snippet each."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        if kind == "documents":
            docs = read_texts(spark, folder, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("id"), "text")
        elif kind == "pages":
            docs = carriers.seeded_texts(spark, folder, "pages", F.col("page_id").cast("string"), F.col("page_id"), "html")
        else:
            docs = carriers.seeded_texts(spark, folder, "conversations", F.concat_ws("/", "conv_id", "turn"), F.col("conv_id") + F.col("turn"), "text")
        return lr.line_findings(explode_lines(docs)).select("id", "line", "rule", "rule_id", "severity", "evidence")

    return run


def plain_findings_sql(docs: str) -> str:
    """``f``: findings of ``docs`` (id, text), as the tail of a WITH clause."""
    cut = LINES_SQL[LINES_SQL.index(", cut AS"):].replace("doc_id, source, path, ", "id, ").lstrip(", ")
    union = " UNION ALL ".join(
        rule_select(r).replace("doc_id, source, path, line, text,", "id, line,") for r in CATALOG
    )
    return f"docs AS ({docs}), {cut}, f AS ({union})"


def _plain_sql(kind: str) -> str:
    docs = {
        "documents": "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents",
        "pages": f"SELECT CAST(page_id AS VARCHAR) AS id, html || chr(10) || body AS text FROM pages JOIN snippets ON page_id % {carriers.PERIOD} = k",
        "conversations": f"SELECT conv_id || '/' || turn AS id, text || chr(10) || body AS text FROM conversations JOIN snippets ON (conv_id + turn) % {carriers.PERIOD} = k",
    }[kind]
    return f"WITH {carriers.SNIPPETS_SQL}, {plain_findings_sql(docs)} SELECT id, line, rule, rule_id, severity, evidence FROM f"


QUERIES = {f"rule_{r.rule}": _rule_query(r.rule) for r in lr.RULES}
ORACLES = {
    f"rule_{r}": f"WITH {LINES_SQL}, f AS ({rule_select(r)}) SELECT doc_id, path, line, rule_id, severity, evidence FROM f"
    for r in CATALOG
}
QUERIES |= {
    "explode_lines": lines_of_documents,
    "page_lines": lines_of_pages,
    "line_rule_pass": line_pass,
    "line_rule_pass_by_text": line_pass_by_text,
    "scan_documents": plain_scan("documents"),
    "scan_pages": plain_scan("pages"),
    "scan_conversations": plain_scan("conversations"),
}
ORACLES |= {
    "explode_lines": f"WITH {LINES_SQL} SELECT doc_id, line, md5(text) AS text_hash FROM lines",
    "page_lines": (
        "WITH docs AS (SELECT page_id, html AS text FROM pages), "
        + LINES_SQL[LINES_SQL.index(", cut AS"):].replace("doc_id, source, path, ", "page_id, ").lstrip(", ")
        + " SELECT page_id, count(*) AS n_lines, max(line) AS last_line, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM lines GROUP BY page_id"
    ),
    "line_rule_pass": PASS_SQL,
    "line_rule_pass_by_text": PASS_SQL,
    "scan_documents": _plain_sql("documents"),
    "scan_pages": _plain_sql("pages"),
    "scan_conversations": _plain_sql("conversations"),
}
