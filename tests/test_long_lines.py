"""Lines of a megabyte: no pattern may recurse once per repetition or read a line over and over."""

import inspect
import time

import pytest
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators import baseline, document_rules, line_rules, rule_catalog, steps
from wardlight.sources.corpus import explode_lines

SIZE = 100_000
LONG = {
    "members": "import requests; requests" + ".a" * SIZE + "(",
    "members_no_call": "requests.Session(); x" + ".ab" * SIZE,
    "libraries": "requests.a.httpx" * (SIZE // 8),
    "session_chain": "c = requests.Session(); " + "c." * SIZE + "get(",
    "dots": "." * (10 * SIZE),
    "open": "eval(" + "(" * (10 * SIZE),
    "close": "x = y" + ")" * (10 * SIZE),
    "pairs": "()" * (5 * SIZE),
    "quotes": '"' * SIZE + "'x' " * SIZE,
    "spans": "os.system('" + "\\'" * SIZE + "')",
    "path": "/home/u" + "/level" * SIZE + "/",
    "up": "../" * SIZE,
    "words": "BEGIN " + "A " * SIZE + "-----BEGIN " + "AB " * SIZE,
    "names": "a_" * SIZE + "key = 'abcdefghijk'",
}


def patterns():
    for module in (rule_catalog, document_rules, baseline, steps, vocab, line_rules):
        for name, value in inspect.getmembers(module):
            if name.startswith("__") or not isinstance(value, str) or "(" not in value or module.__doc__ == value:
                continue
            yield f"{module.__name__.rsplit('.', 1)[-1]}.{name}", value


@pytest.fixture(scope="module")
def long_lines(spark):
    rows = [(i, name, line) for i, (name, line) in enumerate(LONG.items())]
    return spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4).cache()


def test_every_pattern_reads_long_lines(long_lines):
    found = dict(patterns())
    assert len(found) > 40 and any(k.endswith("HTTP_LIBRARY_CALL") for k in found)
    columns = [F.sum(F.size(tx.find_all(F.col("text"), pattern))).alias(f"p{i}") for i, pattern in enumerate(found.values())]
    start = time.time()
    assert len(long_lines.agg(*columns).first()) == len(found)
    assert time.time() - start < 120


def test_rules_read_long_lines(long_lines):
    start = time.time()
    lines = explode_lines(long_lines, "\n")
    rules = {r["path"]: set() for r in long_lines.select("path").collect()}
    for r in line_rules.line_findings(lines).select("path", "rule").collect():
        rules[r["path"]].add(r["rule"])
    assert "http_client" in rules["members"] and "private_key" not in rules["words"]
    sent = {r["path"] for r in document_rules.session_requests(long_lines).select("path").collect()}
    assert "session_chain" not in sent  # reported by the library rule on the same line
    document_rules.document_findings(long_lines).count()
    cleaned = long_lines.select("path", baseline.sanitize_evidence(F.col("text"), "/root").alias("text"))
    ends = {r["path"]: r["text"][-20:] for r in cleaned.collect()}
    assert ends["path"].endswith("<path>/level")
    assert time.time() - start < 240


def test_short_lines_read_as_before(spark):
    calls = ["s.get(", "a.b.s.post (", "get(", "s.getter(", "x().s.get(", "1.s.get(", "é.s.put(", "s.get.y(", "a.get(b.put(", "s . get(", '"s.get("', "`s.get(`"]
    rows = spark.createDataFrame([(c,) for c in calls], "text string")
    found = {r["text"]: r["calls"] for r in rows.select("text", document_rules.session_calls(F.col("text")).alias("calls")).collect()}
    want = {"s.get(": ["s.get("], "a.b.s.post (": ["a.b.s.post ("], "x().s.get(": ["s.get("], "1.s.get(": ["s.get("], "é.s.put(": ["s.put("], "a.get(b.put(": ["a.get(", "b.put("]}
    assert found == {c: want.get(c, []) for c in calls}
    http = {"requests.get(": 1, "requests.a.b(": 1, "requests.Timeout(": 0, "requests.requests.get(": 1, "requests.httpx.Timeout(": 0, "requests.exceptions.Timeout(": 0, "xrequests.get(": 0, "a.requests.get (": 1}
    got = {r["text"]: r["n"] for r in spark.createDataFrame([(c,) for c in http], "text string").select("text", F.size(tx.find_all(F.col("text"), rule_catalog.HTTP_LIBRARY_CALL)).alias("n")).collect()}
    assert got == http
    paths = {"see /a/b/c.txt": "see <path>/c.txt", "/a/b/": "<path>/b/", "/a//b": "<path>/a//b", "x/a/b": "x/a/b", "/": "/", "../../up": "up"}
    got = {r["text"]: r["s"] for r in spark.createDataFrame([(c,) for c in paths], "text string").select("text", F.regexp_replace(F.regexp_replace("text", baseline.ABSOLUTE, "<path>/$1"), baseline.UP_PREFIX, "").alias("s")).collect()}
    assert got == paths
    keys = {"-----BEGIN PRIVATE KEY-----": True, "-----BEGIN RSA PRIVATE KEY-----": True, "-----BEGIN EC X PRIVATE KEY-----": True, "-----BEGIN PUBLIC KEY-----": False, "-----BEGIN rsa PRIVATE KEY-----": False}
    got = {r["text"]: r["s"] for r in spark.createDataFrame([(c,) for c in keys], "text string").select("text", tx.has(F.col("text"), rule_catalog.PRIVATE_KEY).alias("s")).collect()}
    assert got == keys
