"""Rules that need a whole document: client sessions, encoded payloads, claims of one file.

What a line rule cannot know (is this name a session, does the text run what
it decodes) is a property of the document row. It is computed there and goes
along with the exploded lines, so these rules do not shuffle either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.functions import text as tx
from wardlight.operators import rule_catalog as rc
from wardlight.operators.line_rules import (
    calls_http_object, live_matches, with_catalog,
)
from wardlight.sources.corpus import explode_lines

NEWLINE = "\n"
STRETCH = 256  # lines of a file that stay together where its claims meet their facts
_ASSIGN = (
    r"(?m)^[ \t]*((?:[A-Za-z_]\w*+\.)*+[A-Za-z_]\w*+)[ \t]*(?::[^=\n]+)?=[ \t]*" + rc.SESSION_CTOR + r"[ \t]*\("
)
_WITH_AS = (
    r"(?s)\bwith\b[^\n:]*?" + rc.SESSION_CTOR + r"[ \t]*\((?:[^()]++|\([^()]*+\))*+\)[ \t]*as[ \t]+([A-Za-z_]\w*)"
)


def session_names(text: Column) -> Column:
    """Names a document binds to a client session, by assignment or ``with ... as``."""
    return F.array_sort(F.array_distinct(F.concat(tx.find_all(text, _ASSIGN, 1), tx.find_all(text, _WITH_AS, 1))))


def session_bindings(docs: DataFrame) -> DataFrame:
    kept = [c for c in docs.columns if c != "text"]
    might = F.col("text").contains("requests.Session") | F.col("text").contains("httpx.Client")
    return docs.where(might).select(*kept, F.explode(session_names(F.col("text"))).alias("name"))


def session_calls(text: Column) -> Column:
    """Live calls of a request verb on a dotted name. A chain is one token, however long, so a line is read once."""
    return F.filter(live_matches(text, rc.DOTTED_NAME), lambda t: tx.has(t, rc.SESSION_CALL + "$"))


def _senders(call: Column, names: Column) -> Column:
    """``a.b.c.get(`` may be sent by ``c``, ``b.c`` or ``a.b.c``: the names of a document among them."""
    chain = F.regexp_replace(call, r"\.\w+[ \t]*\($", "")
    return F.filter(names, lambda n: (chain == n) | chain.endswith(F.concat(F.lit("."), n)))


def session_requests(docs: DataFrame) -> DataFrame:
    """Requests through a session of the same document, on lines no library rule reports."""
    kept = [c for c in docs.columns if c != "text"]
    might = F.col("text").contains("requests.Session") | F.col("text").contains("httpx.Client")
    bound = docs.where(might).withColumn("_names", session_names(F.col("text"))).where(F.size("_names") > 0)
    lines = explode_lines(bound, NEWLINE).where(tx.has(F.col("text"), rc.SESSION_CALL))
    calls = lines.select(*kept, "_names", "line", "text", F.explode(session_calls(F.col("text"))).alias("call"))
    hits = (
        calls.select(*kept, "line", "text", F.explode(_senders(F.col("call"), F.col("_names"))).alias("name"))
        .where((F.size(live_matches(F.col("text"), rc.HTTP_CLIENT)) == 0) & ~calls_http_object(F.col("text")))
    )
    return hits.select(*kept, "line", F.lit("session_request").alias("rule"), tx.strip(F.col("text")).alias("matched_text"))


def _rot13(text: Column) -> Column:
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    turned = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
    return F.translate(text, plain, turned)


def _base64_text(token: Column) -> Column:
    """Decoded token, padded as needed; null when it is not base64."""
    size = F.length(token)
    body = F.length(F.rtrim(token, F.lit("=")))
    padded = F.rpad(token, (F.ceil(size / 4) * 4).cast("int"), "=")
    # more than two padding characters in all is no base64
    fits = F.length(padded) - body <= 2
    return F.when(fits, F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))


def payloads(docs: DataFrame) -> DataFrame:
    """Encoded text that decodes to something dangerous and is run or fetched in the same document."""
    text = F.col("text")
    kept = [c for c in docs.columns if c != "text"]
    encoded, runs = "[A-Za-z0-9+/]{16}|(?i:rot13)", "(?i)" + tx.any_word(["sh", "run", "exec", "eval"])
    fetches = ["(?i)" + tx.any_word(words) for words in (["fetch", "download", "retrieve", "get", "run", "execute"], ["content", "url", "script", "payload"])]
    able = tx.matching(text, [[encoded, runs], [encoded, *fetches], [encoded, "[\u017f\u0130\u0131]"]]) != 0
    hides = text.rlike(r"[A-Za-z0-9+/]{16}") | tx.has(text, rc.ROT13_INDICATOR, fold=True)
    flag = F.struct(
        tx.has(text, rc.EXECUTION_CONTEXT, fold=True).alias("_runs"), tx.has(text, rc.FETCH_CONTEXT, fold=True).alias("_fetches"),
        tx.has(text, rc.ROT13_INDICATOR, fold=True).alias("_rot13"),
    )
    # unfolded from an array: a filter on the flags would be pushed below the projection and read the texts again
    flags = (
        docs.withColumn("_able", able)
        .select(*docs.columns, F.explode(F.array_compact(F.array(F.when(F.col("_able") & hides, flag)))).alias("_flag"))
        .select(*docs.columns, "_flag.*")
        .where("_runs OR _fetches")
    )
    lines = explode_lines(flags, NEWLINE)

    def danger(decoded: Column) -> Column:
        return tx.has(decoded, rc.DANGEROUS_COMMAND, fold=True)

    def item(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))

    tokens = F.regexp_extract_all(text, F.lit(rc.BASE64_TOKEN), F.lit(0))
    phrases = F.when(F.col("_rot13"), F.regexp_extract_all(text, F.lit(rc.QUOTED_PHRASE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = lines.select(
        *kept, "line", "_runs", "_fetches", "_rot13",
        F.explode(F.concat(
            F.transform(tokens, item("token")), F.transform(phrases, item("phrase")),
        )).alias("p"),
    )
    value, kind = F.col("p.value"), F.col("p.kind")
    decoded = found.withColumn("_b64", F.when(kind == "token", _base64_text(value))).withColumn(
        "_turned",
        F.when(F.col("_rot13") & ((kind == "token") | value.rlike(rc.ROT13_SHAPE)), _rot13(value)),
    )
    b64, turned = F.col("_b64"), F.col("_turned")
    rules = F.array_compact(F.array(
        F.when(F.col("_runs") & danger(b64), F.lit("base64_command"))
        .when(F.col("_fetches") & tx.has(b64, rc.REMOTE_SCRIPT_URL, fold=True), F.lit("base64_url")),
        F.when(F.col("_runs") & danger(turned), F.when(kind == "token", F.lit("rot13_token")).otherwise(F.lit("rot13_phrase"))),
    ))
    return decoded.select(*kept, "line", F.explode(rules).alias("rule"))


def document_findings(docs: DataFrame) -> DataFrame:
    """Findings of the document rules in the shape of the line findings."""
    requests = session_requests(docs)
    hidden = payloads(docs).withColumn("matched_text", F.lit(None).cast("string"))
    rows = requests.unionByName(hidden).withColumn("found", F.lit(None).cast("string"))
    named = with_catalog(rows)
    return named.withColumn("matched_text", F.coalesce(F.nullif("matched_text", F.lit("")), "evidence"))


# ------------------------------------------------------- one claim per file


def _no_imports(text: Column) -> Column:
    """Blank import statements, keeping double quotes for the mention test."""
    head = tx.first_match(text, rc.IMPORT_STATEMENT)
    return F.concat(F.regexp_replace(head, '[^"]', " "), F.substring(text, F.length(head) + 1, F.length(text)))


def collapse_http_claims(findings: DataFrame, file: Sequence[str]) -> DataFrame:
    """Keep one statement per fact: calls over imports, requests over constructions.

    ``file`` names one file of one target. A file without a call keeps its first import,
    one without a request its first construction. Facts are an aggregate of a few flags,
    so a file with many findings is combined before it is shuffled; the rows find their
    facts by (file, stretch of lines), so it is not one task afterwards either.
    ``findings`` is read three times and should be written down.
    """
    claim = (F.col("rule_id") == "AS-003") & (F.col("severity") == "MEDIUM")
    rest = findings.where(~claim)
    text = F.coalesce("matched_text", F.lit(""))
    rows = (
        findings.where(claim)
        .withColumn("_part", F.floor(F.coalesce("line", F.lit(0)) / STRETCH))
        .withColumn("_calls", (F.size(live_matches(_no_imports(text), rc.HTTP_CALL)) > 0) | (F.size(session_calls(text)) > 0))
        .withColumn("_declares", tx.has(text, rc.HTTP_DECLARATION) & ~F.col("_calls"))
        .withColumn("_builds", F.size(live_matches(text, rc.CLIENT_CONSTRUCTION)) > 0)
    )
    place = F.coalesce("line", F.lit(0))
    spread = rows.groupBy(*file, "_part").agg(
        F.bool_or(~F.col("_builds") & ~F.col("_declares")).alias("requesting"),
        F.bool_or("_calls").alias("calling"),
        F.min(F.when(F.col("_declares"), place)).alias("first_declared"),
        F.min(F.when(F.col("_builds"), place)).alias("first_built"),
    )
    whole = W.partitionBy(*file)
    facts = spread.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*file, "_part"])], F.bool_or("requesting").over(whole).alias("requesting"),
        F.bool_or("calling").over(whole).alias("calling"), F.min("first_declared").over(whole).alias("first_declared"), F.min("first_built").over(whole).alias("first_built"),
    )
    same = F.lit(True)
    for i, c in enumerate([*file, "_part"]):
        same = same & rows[c].eqNullSafe(facts[f"_k{i}"])
    drop = (
        (F.col("_declares") & (F.col("calling") | (place != F.col("first_declared"))))
        | (F.col("_builds") & (F.col("requesting") | (place != F.col("first_built"))))
    )
    kept = rows.join(facts, same).where(~F.coalesce(drop, F.lit(False))).select(*[rows[c] for c in findings.columns])
    return rest.unionByName(kept)


