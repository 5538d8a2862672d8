"""Baselines, reports, evaluations, extensions and streams."""

import collections
import hashlib
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators import baseline as bl
from wardlight.operators import enrich as en
from wardlight.operators import evaluation as ev
from wardlight.operators import extend as ex
from wardlight.operators import line_rules as lr
from wardlight.operators import scoring as sc
from wardlight.plans.q_reports import stream_new, stream_scan
from wardlight.plans.q_rules import seeded_findings
from wardlight.sources import reports as rp
from wardlight.sources import snapshots as sn
from wardlight.streaming import arrivals as ar

RECORD = "ord int, rule_id string, file string, line int, evidence string, severity string"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first().r


def test_locations(spark):
    def place(path):
        return one(spark, lambda c: bl.relative_location(c, "/b/w"), path)

    assert place("/b/w/x/a.md") == "x/a.md"
    assert place("/b/w/./x/../a.md") == "a.md"
    assert place("/b/w2/a.md") == "<outside>/a.md"
    assert place("/b/w") == "<outside>/w"
    assert place("<correlated>") == "<correlated>"


def test_evidence_keeps_no_host_path(spark):
    def scrub(text):
        return one(spark, lambda c: bl.sanitize_evidence(c, "/b/w", "/home/me", "/cwd"), text)

    assert scrub("Contributing: /b/w/x/a.md:3, https://h/x/../y") == "Contributing: x/a.md:3, https://h/x/../y".replace("/../", "/<up>/")
    assert scrub("see a/b ./c and 1/2") == "see a/b ./c and 1/2"
    assert scrub("plain words") == "plain words"
    assert "/usr" not in scrub("log in /usr/share/x.log")


def test_difference_counts_repeats(spark):
    rng = random.Random(6)
    def some(n):
        return [(i, f"R{rng.randrange(2)}", f"f{rng.randrange(2)}", rng.choice([None, 1, 2]), "e", rng.choice(["LOW", "HIGH"])) for i in range(n)]

    now, then = some(120), some(90)
    a, b = spark.createDataFrame(now, RECORD), spark.createDataFrame(then, RECORD)
    want_then = collections.Counter(r[1:] for r in then)
    seen, want = collections.Counter(), {}
    for r in now:
        seen[r[1:]] += 1
        want[r[0]] = "matched" if seen[r[1:]] <= want_then[r[1:]] else "new"
    state = bl.annotate(a, b, ["ord"], F.floor(F.col("ord") / 7))
    assert {r.ord: r.baseline_state for r in state.collect()} == want
    counts = bl.diff_counts(a, b).first()
    assert counts.matched + counts.new == 120 and counts.matched + counts.fixed == 90
    missing = want_then - collections.Counter(r[1:] for r in now)
    assert collections.Counter(tuple(r) for r in bl.fixed_rows(a, b).collect()) == missing


def test_excluded_rows_are_not_compared(spark):
    rows = spark.createDataFrame([(1, "R", "f", 1, "e", "LOW"), (2, "R", "g", 1, "e", "LOW")], RECORD)
    state = bl.annotate(rows, rows, ["ord"], F.col("ord"), excluded=F.col("file") == "g")
    assert {r.file: r.baseline_state for r in state.collect()} == {"f": "matched", "g": None}
    assert sc.gate(state.withColumn("severity", F.lit("HIGH")), ["file"], only_new=True).where("exit_code = 1").first().file == "g"


def test_finding_ids(spark):
    rows = spark.createDataFrame([(1, "R", "a\\b", None, "e\x1f", "LOW")], RECORD)
    text = "\x1f".join(["R", "a\\\\b", "", "e\\x1f", "LOW"])
    found = bl.with_ids(rows).first().finding_id
    assert found == "fnd-" + hashlib.sha256(text.encode()).hexdigest()[:12]
    assert bl.lookup(bl.with_ids(rows), "finding_id", found).file == "a\\b"
    with pytest.raises(LookupError):
        bl.lookup(bl.with_ids(rows.unionByName(rows)), "finding_id", found)
    with pytest.raises(LookupError):
        bl.lookup(bl.with_ids(rows), "finding_id", "fnd-0")


def test_snapshots_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "R2", "b", 7, "é", "LOW"), (2, "R1", "a", None, "x", "HIGH"), (3, "R1", "a", 2, "x", "HIGH")], RECORD)
    out = str(tmp_path / "snap")
    sn.write_snapshot(rows, out)
    text = "".join(p.read_text() for p in (tmp_path / "snap").glob("part-*"))
    assert [r["line"] for r in json.loads(text)["findings"]] == [None, 2, 7]
    assert sorted(map(str, sn.read_snapshot(spark, out + "/part-*").collect())) == sorted(map(str, rows.select(*bl.KEY).collect()))
    bad = tmp_path / "bad.json"
    for content in ("[]", "{", '{"version": 2, "findings": []}', '{"version": 1}', '{"version": 1, "findings": [3]}',
                    '{"version": 1, "findings": [{"rule_id": "R", "file": "f", "line": true, "evidence": "e", "severity": "LOW"}]}',
                    '{"version": 1, "findings": [{"rule_id": "R", "file": "f", "line": 1, "severity": "LOW"}]}'):
        bad.write_text(content)
        with pytest.raises(sn.SnapshotError):
            sn.read_snapshot(spark, str(bad))
    bad.write_bytes(b" " * (vocab.MAX_BASELINE_BYTES + 1))
    with pytest.raises(sn.SnapshotError, match="too large"):
        sn.read_snapshot(spark, str(bad), max_bytes=vocab.MAX_BASELINE_BYTES)
    same = rows.unionByName(rows).unionByName(rows)
    sn.write_snapshot(same, out)
    assert sn.read_snapshot(spark, out + "/part-*").count() == 9
    with pytest.raises(sn.SnapshotError, match="too many"):
        sn.read_snapshot(spark, out + "/part-*", max_records=8)
    sn.write_records(same, str(tmp_path / "records"))
    assert sorted(map(str, sn.read_records(spark, str(tmp_path / "records")).collect())) == sorted(map(str, same.select(*bl.KEY).collect()))


def findings(spark):
    rows = [
        ("t", "a.md", 1, 0, "AS-002", "HIGH", "Shell eval", "d", "eval statement", "eval $X", False, None, "new"),
        ("t", "a.md", None, 0, "AS-CHAIN-002", "CRITICAL", "Chain", "d", "e", None, False, None, "matched"),
        ("t", "b\\c.md", 2, 1, "AS-005", "LOW", "Suspicious URL", "MCP server 'files' x", "see EVIL.example", "", True, "why", None),
    ]
    schema = "target string, file string, line int, ord int, rule_id string, severity string, title string, description string, evidence string, matched_text string, suppressed boolean, suppression_reason string, baseline_state string"
    return en.enrich(spark.createDataFrame(rows, schema).withColumn("remediation", F.lit("fix")))


def test_enrichment(spark):
    rows = {r.rule_id: r for r in findings(spark).collect()}
    assert [m.id for m in rows["AS-002"].mitre] == ["T1059", "T1059.004"]
    assert rows["AS-CHAIN-002"].confidence == "HIGH" and rows["AS-CHAIN-002"].matched_text == "e"
    assert rows["AS-005"].cwe == [] and rows["AS-005"].mitre == []


def test_suppression_order(spark):
    raw = findings(spark).drop("suppressed", "suppression_reason")
    def reason(**lists):
        return [r.suppression_reason for r in en.suppress(raw, **lists).where("rule_id = 'AS-005'").collect()][0]

    assert reason(rules=["AS-005"], servers=["files"], domains=["evil.example"]) == "rule AS-005 ignored"
    assert reason(servers=["files"], domains=["evil.example"]) == "MCP server 'files' ignored"
    assert reason(domains=["  Evil.Example "]) == "domain ignored"
    assert reason(servers=["file"], domains=[" "]) is None


def test_sarif(spark):
    best = spark.createDataFrame([("a.md", "p1", "DATA_EXFILTRATION", "HIGH")], "uri string, super_id string, super_type string, super_risk string")
    rows = {r.rule_id: json.loads(r.json) for r in rp.result_json(rp.sarif_results(findings(spark), best)).collect()}
    assert rows["AS-002"]["level"] == "error" and rows["AS-002"]["baselineState"] == "new" and "suppressions" not in rows["AS-002"]
    assert rows["AS-002"]["message"]["text"] == "Shell eval: eval $X"
    assert rows["AS-CHAIN-002"]["properties"]["superseded_by_path"] == "p1" and rows["AS-CHAIN-002"]["baselineState"] == "unchanged"
    assert "region" not in rows["AS-CHAIN-002"]["locations"][0]["physicalLocation"]
    assert rows["AS-005"]["suppressions"] == [{"kind": "external", "justification": "why"}]
    assert rows["AS-005"]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "b/c.md"
    assert rp.sarif_artifacts(findings(spark), ["target"]).count() == 2


def document(rows):
    return json.loads("".join(r.json for r in sorted(rows.collect(), key=lambda r: (r.section, r.pos))))


def test_scan_document(spark, tmp_path):
    keys = ["target"]
    cover = spark.createDataFrame([("t", "full", 2), ("u", "none", 0)], "target string, coverage_status string, files_scanned int")

    def lines(rows, chunk=None):
        return rp.scan_json(rows, sc.scores(rows, keys), sc.severity_summary(rows, keys), cover, keys, ["file", "ord"], chunk)

    few = findings(spark)
    doc = document(lines(few).where("target = 't'"))
    assert doc["score"] == 65 and len(doc["findings"]) == 3 and doc["summary"]["suppressed"] == 1
    assert document(lines(few).where("target = 'u'"))["findings"] == []
    many = few.where("rule_id = 'AS-002'").withColumn("ord", F.explode(F.sequence(F.lit(1), F.lit(10_500)))).withColumn("line", F.col("ord"))
    doc = document(lines(many, F.floor(F.col("ord") / 512)).where("target = 't'"))
    assert [f["line"] for f in doc["findings"]] == list(range(1, 10_501)) and doc["n_findings"] == 10_500
    rp.write_documents(lines(few), str(tmp_path / "docs"), keys)
    text = "".join(p.read_text() for p in sorted((tmp_path / "docs" / "target=t").glob("part-*")))
    assert len(json.loads(text)["findings"]) == 3


def test_sarif_run_is_one_document(spark):
    found = findings(spark)
    results = rp.result_json(rp.sarif_results(found)).select("target", "file", "ord", "json")
    run = document(rp.sarif_run(results, rp.sarif_rules(found, ["target"], ["file", "ord"]), rp.sarif_artifacts(found, ["target"]), ["target"], ["file", "ord"]))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["AS-002", "AS-005", "AS-CHAIN-002"]
    assert len(run["results"]) == 3 and [a["location"]["uri"] for a in run["artifacts"]] == ["a.md", "b/c.md"]


def test_escaping(spark):
    raw = "a\\b\x1b[0m\n é \u200b \U000e0001"
    want = "a\\\\b\\x1b[0m\\x0a é \\u200b \\U000e0001"
    assert one(spark, tx.escape_untrusted, raw) == want
    assert one(spark, tx.escape_untrusted, "x" * 600) == "x" * 500 + " [truncated]"


def test_case_classification(spark):
    cases = [("a", "c", ["AS-003"], False), ("b", "c", ["AS-002"], False), ("d", "c", [], False), ("e", "k", [], True), ("f", "k", [], True), ("g", "k", [], False)]
    found = [("a", "AS-003", "LOW"), ("b", "AS-003", "LOW"), ("d", "AS-005", "LOW"), ("e", "AS-002", "HIGH"), ("f", "AS-005", "MEDIUM")]
    rows = ev.classify_cases(
        spark.createDataFrame(cases, "name string, category string, expected_rules array<string>, is_benign boolean"),
        spark.createDataFrame(found, "name string, rule_id string, severity string"), ["name"],
    )
    assert {r.name: r.result for r in rows.collect()} == {
        "a": "PARTIALLY_DETECTED", "b": "MISSED", "d": "PARTIALLY_DETECTED", "e": "FALSE_POSITIVE", "f": "DETECTED", "g": "MISSED",
    }
    total = ev.lab_summary(rows).first()
    assert (total.total, total.detected, total.missed, total.detection_percentage) == (6, 1, 2, 16.7)


def test_wilson_interval(spark):
    rows = spark.createDataFrame([("x", "TP")] + [("x", "FP")] * 66 + [("y", "INCONCLUSIVE")], "k string, verdict string")
    got = {r.k: (r.precision, r.low, r.high) for r in ev.precision(rows, ["k"]).collect()}
    assert tuple(round(100 * v, 1) for v in got["x"]) == (1.5, 0.3, 8.0)
    assert got["y"] == (None, None, None)


def test_evaluation(spark):
    cases = spark.createDataFrame([("b", "1", ["x", " y "]), ("b", "2", ["x"]), ("b", "3", [])], "benchmark_id string, case_id string, expected_security_properties array<string>")
    seen = spark.createDataFrame([("b", "1", ["y"], "completed", " "), ("b", "2", ["x"], "error", "m"), ("b", "9", [], "completed", "m")], "benchmark_id string, case_id string, observed_properties array<string>, status string, message string")
    rows = {r.case_id: r for r in ev.evaluate(cases, seen).collect()}
    assert (rows["1"].passed, rows["1"].violated_properties, rows["1"].message) == (False, ["x"], ev.DEFAULT_MESSAGE)
    assert rows["2"].passed and rows["2"].status == "error"
    assert {(r.case_id, r.problem) for r in ev.unbound(cases, seen).collect()} == {("9", "no such case"), ("3", "not executed")}
    s = ev.summarize(ev.evaluate(cases, seen)).first()
    assert (s.total_cases, s.passed_cases, s.failed_cases, s.error_cases) == (2, 0, 1, 1)
    # what an execution reported about itself does not count
    assert ev.summarize(ev.evaluate_executions(cases, seen)).first().error_cases == 0


def test_adapted_cases(spark):
    raw = spark.createDataFrame([('{"case_id": " c ", "name": "n", "description": "d", "threat_ids": ["B", " A ", "", "A"]}',), ('{"case_id": "", "name": "n"}',)], "json string")
    good, refused = ev.adapt_cases(raw, "bench")
    row = good.first()
    assert (row.benchmark_id, row.case_id, row.threat_ids, row.expected_security_properties) == ("bench", "c", ["A", "B"], [])
    assert refused.first().reason == "empty case_id, description"
    mapped = ev.map_threats(spark.createDataFrame([("s", ["ASI01", "XX"])], "scenario_id string, threat_ids array<string>"), ev.taxonomy(spark))
    assert {(r.threat_id, r.entry_name) for r in mapped.collect()} == {("ASI01", "Agent Goal Hijack"), ("XX", None)}
    assert ev.duplicate_entries(ev.taxonomy(spark)).count() == 0


def test_python_rule_errors_are_recorded(spark):
    lines = spark.createDataFrame([(1, "fine"), (2, "bad")], "line int, text string")
    def judge(text):
        if text == "bad":
            raise KeyError(text)
        return "seen"

    rows = ex.apply_python_rule(lines, "mine", judge).orderBy("line").collect()
    assert [(r.line, r.evidence, r.reason, r.error_type) for r in rows] == [(1, "seen", None, None), (2, None, "line_rule_exception", "KeyError")]


def test_pattern_table_does_not_depend_on_its_size(spark):
    lines = spark.createDataFrame([(1, "Drop the table"), (2, "drop it"), (3, "all tokens here"), (4, "a token here"), (5, "x"), (6, "re-use of io")], "line int, text string")
    rules = [("a", "drop", r"\bdrop\b"), ("b", "the table", r"\bthe\s+table\b"), ("c", "token", r"\btoken\w*"), ("d", "x", "^x$"), ("e", "re-use", "re-use"), ("a", "drop it", "drop it")]
    want = [(1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "c"), (5, "d"), (6, "e")]
    more = [(f"n{i}", f"zz{i}", f"zz{i}") for i in range(600)]
    for table in (rules, rules + more):
        found = ex.match_pattern_table(lines, spark.createDataFrame(table, "pattern_id string, stem string, pattern string")).collect()
        assert sorted((r.line, r.pattern_id) for r in found) == want
    with pytest.raises(ValueError):
        ex.match_pattern_table(lines, spark.createDataFrame([("f", "--", "--")], "pattern_id string, stem string, pattern string"))


@pytest.mark.parametrize("stems, words", [(64, 200_000), (0, 200_000), (0, 0)])
def test_pattern_table_deals_out_no_text_per_word(spark, tmp_path, monkeypatch, stems, words):
    """Every way gives the same rows, and what is written between stages grows with a line, not with its square."""
    monkeypatch.setattr(ex, "FEW_STEMS", stems)
    monkeypatch.setattr(ex, "FEW_WORDS", words)
    rules = spark.createDataFrame([("a", "w77x", "w77x"), ("a", "w9999", "w9999"), ("b", "zzzz", "zzzz"), ("c", "longer word", "longer +word")], "pattern_id string, stem string, pattern string")
    longest = " ".join(f"w{i}x" for i in range(8000))
    rows = [(1, longest + " W9999"), (2, "one w77x"), (2, "one w77x"), (3, "a longer word"), (4, "longer"), (5, "y" * 5000 + "zzzz"), (6, None), (7, "")]
    lines = spark.createDataFrame(rows, "line int, text string").coalesce(1)
    lines.write.parquet(str(tmp_path / "lines"))
    found = ex.match_pattern_table(spark.read.parquet(str(tmp_path / "lines")), rules)
    assert sorted((r.line, r.pattern_id) for r in found.collect()) == [(1, "a"), (2, "a"), (3, "c"), (5, "b")]
    metrics = _shuffled(found)
    assert metrics < 3_000_000, metrics


def _shuffled(df) -> int:
    """Bytes of the rows that shuffles of a fresh run of ``df`` write, before compression."""
    df = df.select("*")
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("dataSize").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_inputs_that_are_used_twice_are_computed_once(spark):
    """Findings cost a pass over all texts, so an operator that needs them twice writes them down."""
    rows = spark.createDataFrame([("1", f"/srv/a/f{i % 3}", i, f"R-{i % 2}", "see f1:2", "HIGH") for i in range(12)], "id string, path string, line int, rule_id string, evidence string, severity string").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def told(value):
        seen.add(1)
        return value

    counted = rows.withColumn("path", F.udf(told)("path")).withColumn("file", F.col("path"))
    roots = spark.createDataFrame([("/srv/a",)], "root string")
    runs = {
        "rooted": lambda: bl.rooted(counted, roots),
        "records": lambda: bl.sorted_records(counted),
        "known": lambda: bl.rewrite_known_files(counted.withColumn("id", F.concat("path", "line")), rows.select("path"), "/srv", "/srv", "id"),
        "resolve": lambda: bl.resolve(rows.select("path", "rule_id"), "path", counted.select("path")),
    }
    for name, run in runs.items():
        before = seen.value
        run().collect()
        assert seen.value - before == 12, name


def test_a_fingerprint_that_holds_most_rows(spark):
    hot = [(i, "R", "f", 1, "e", "LOW") for i in range(2000)]
    rows = spark.createDataFrame(hot + [(5000 + i, "R", f"g{i}", 1, "e", "LOW") for i in range(200)], RECORD)
    then = spark.createDataFrame(hot[:700], RECORD)
    for base in (then, bl.count_keys(then)):
        state = bl.annotate(rows, base, ["ord"], F.floor(F.col("ord") / 64))
        assert {r.ord for r in state.where("baseline_state = 'matched'").collect()} == set(range(700))


def test_resolved_ids(spark):
    rows = spark.createDataFrame([("i", "R", "a"), ("j", "R", "b"), ("j", "S", "c")], "id string, rule_id string, file string")
    got = {r.id: (r.n_records, r.rule_id, r.file) for r in bl.resolve(rows, "id", spark.createDataFrame([("i",), ("j",), ("k",), ("k",)], "id string")).collect()}
    assert got == {"i": (1, "R", "a"), "j": (2, None, None), "k": (0, None, None)}


def test_document_rules_register(spark):
    book = ex.RuleBook()
    book.register_document_rule(lambda docs: docs.where(F.length("text") > 3).select("path", F.lit("long").alias("rule")))
    docs = spark.createDataFrame([("a", "abc"), ("b", "abcdef")], "path string, text string")
    assert [r.path for r in book.document_findings(docs)[0].collect()] == ["b"]


def test_stream_reads_files_as_they_come(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "doc_id int, text string"
    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)

    def drain():
        docs = ar.read_documents(spark, src, spark.createDataFrame([], schema).schema)
        ar.write_findings(ar.stream_findings(docs).select("doc_id", "line", "rule"), out, mark, available_now=True).awaitTermination()
        return sorted((r.doc_id, r.rule) for r in spark.read.parquet(out).collect())

    arrive([(1, "quiet\neval(x)")])
    assert drain() == [(1, "eval_exec")]
    arrive([(2, "import requests")])
    assert drain() == [(1, "eval_exec"), (2, "http_client")]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_queries_read_a_table_of_part_files(spark, tmp_path, files):
    """A table may be one file or a folder of them; the streams read what the batch queries read."""
    docs = spark.range(96).selectExpr("id AS doc_id", "'plain text' AS text", "'en' AS lang", "'web' AS source", "10L AS n_chars")
    docs.repartition(files).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    folder = tmp_path / "many"
    if files == 1:
        folder = tmp_path / "one"
        folder.mkdir()
        (part,) = (tmp_path / "many" / "documents.parquet").glob("part-*.parquet")
        shutil.copy(part, folder / "documents.parquet")
    want = seeded_findings(spark, str(folder)).select("doc_id", "line", "rule", "rule_id", "severity", "evidence").collect()
    assert want
    found = stream_scan(spark, str(folder)).collect()
    assert sorted(map(tuple, found)) == sorted((r.doc_id, r.line, r.rule, r.severity) for r in want)
    new = stream_new(spark, str(folder)).collect()
    assert sorted(map(tuple, new)) == sorted((r.doc_id, r.line, r.rule_id, r.evidence) for r in want if r.rule_id == "AS-002")


def test_stream_emits_only_new_findings(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = [("a", "eval(x)\neval(x)"), ("b", "eval(x)")]
    spark.createDataFrame(rows, "file string, text string").write.parquet(src)
    docs = ar.read_documents(spark, src, spark.read.parquet(src).schema)
    found = ar.stream_findings(docs).select("rule_id", "file", "line", "evidence", "severity", "rule_order")
    known = spark.createDataFrame([("AS-002", "a", 1, "eval/exec of a variable", "HIGH")], "rule_id string, file string, line int, evidence string, severity string")
    ar.write_new_findings(found, known, out, mark, available_now=True).awaitTermination()
    assert sorted((r.file, r.line) for r in spark.read.parquet(out).collect()) == [("a", 2), ("b", 1)]


def test_rules_are_pure_functions_of_the_text(spark):
    """The same line gives the same findings wherever it stands."""
    lines = spark.createDataFrame([("x.py", 1, "os.system(c)"), ("y.md", 977, "os.system(c)")], "path string, line int, text string")
    assert {r.rule for r in lr.line_findings(lines).collect()} == {"os_system"}


def test_a_file_in_several_batches_is_counted_once(spark, tmp_path):
    """Parts of one file arrive one by one; the stream says what the whole file says, a restart and folded state included."""
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "rule_id string, file string, line int, evidence string, severity string, rule_order int"
    rows = [("R", f, i, "same", "HIGH", 0) for f in ("a", "b") for i in (1, 1, 1, 2, 3, 3, 700)] + [("R", None, 5, "x", "LOW", 0)] * 3
    known = spark.createDataFrame([("R", "a", 1, "same", "HIGH")] * 2 + [("R", "a", 3, "same", "HIGH")] + [("R", "b", 1, "same", "HIGH")] * 5 + [("R", None, 5, "x", "LOW")], "rule_id string, file string, line int, evidence string, severity string")
    whole = spark.createDataFrame(rows, schema)
    want = sorted(map(str, bl.annotate(whole, known, ["line", "rule_order"], F.floor(F.col("line") / 256)).where("baseline_state = 'new'").select("file", "line").collect()))
    for part in range(4):
        some = [r for i, r in enumerate(rows) if i % 4 == part]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(src)
        docs = ar.read_documents(spark, src, whole.schema, files_per_batch=1)
        ar.write_new_findings(docs, known, out, mark, available_now=True, fold_every=2).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(map(str, got.select("file", "line").collect())) == want
    assert got.select("batch").distinct().count() > 2
