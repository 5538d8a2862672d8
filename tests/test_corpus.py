"""Files to lines: admission, decoding, pruning, coverage."""

import random

from pyspark.sql import functions as F

from wardlight.operators import scoring as sc
from wardlight.sources import corpus

FILES = [
    ("t/SKILL.md", b"hello\r\nworld\n"), ("t/x.md", b"ab\x00cd"), ("t/u16.md", "hé\nllo 𝄞".encode("utf-16")), ("t/u16be.txt", b"\xfe\xff" + "héllo".encode("utf-16-be")),
    ("t/u32.txt", "héllo".encode("utf-32")), ("t/u32be.txt", b"\x00\x00\xfe\xff" + "héllo".encode("utf-32-be")), ("t/bad16.md", b"\xff\xfe\x00\xd8\x41\x00"),
    ("t/odd.md", b"\xff\xfea\x00b"), ("t/latin.txt", b"caf\xe9 x\n"), ("t/.env", b"K=1"), ("t/app.env", b"K=1"), ("t/pic.png", b"..."),
    ("t/node_modules/p/i.js", b"x"), ("t/.git/config.cfg", b"x"), ("t/big.txt", b"x" * 1_000_001), ("t/late.md", b"x" * 8192 + b"\x00"),
]


def file_table(spark, files=FILES):
    return spark.createDataFrame([(p, len(b), bytearray(b)) for p, b in files], "path string, length long, content binary")


def test_decode_and_reasons(spark):
    left, pruned = corpus.prune(file_table(spark))
    rows = {r.path[2:]: r for r in corpus.decode(left, max_bytes=1_000_000, probe_bytes=8192).collect()}
    whole = {r.path[2:]: r.skip_reason for r in corpus.decode(left).collect()}
    assert whole["big.txt"] is None and whole["late.md"] == "binary"
    assert rows["u16.md"].text == "hé\nllo 𝄞"
    assert rows["u16be.txt"].text == rows["u32.txt"].text == rows["u32be.txt"].text == "héllo"
    assert {p: r.skip_reason for p, r in rows.items() if r.skip_reason} == {
        "x.md": "binary", "bad16.md": "binary", "odd.md": "binary", ".env": "not_scannable", "pic.png": "not_scannable", "big.txt": "too_large",
    }
    assert rows["latin.txt"].lossy and "�" in rows["latin.txt"].text
    assert not rows["late.md"].lossy and rows["late.md"].text.endswith("\x00")
    assert {tuple(r) for r in pruned.collect()} == {("t/node_modules", "vendored_dir"), ("t/.git", "ignored_dir")}


def test_links_and_exclusions(spark):
    files = file_table(spark)
    links = spark.createDataFrame([("t/link",)], "path string")
    _, pruned = corpus.prune(files, links=links)
    assert ("t/link", "symlink_dir") in {tuple(r) for r in pruned.collect()}
    left, skipped = corpus.excluded(files, spark.createDataFrame([("t/SKILL.md",), ("t/none",)], "path string"))
    assert left.count() == len(FILES) - 1
    assert [tuple(r) for r in skipped.collect()] == [("t/SKILL.md", "baseline_snapshot")]


def test_coverage_verdicts(spark):
    def status(rows):
        events = spark.createDataFrame([("t", *r) for r in rows], "target string, kind string, reason string")
        return sc.coverage_status(events, ["target"]).first().coverage_status

    assert status([("scanned", None)]) == "full"
    assert status([("scanned", None), ("pruned", "ignored_dir"), ("pruned", "symlink_dir")]) == "full"
    assert status([("scanned", None), ("pruned", "vendored_dir")]) == "partial"
    assert status([("scanned", None), ("rule_error", "line_rule_exception")]) == "partial"
    assert status([("decode_error", "decode_error")]) == "partial"
    assert status([("skipped", "binary")]) == "none"


def test_binary_file_source(spark, tmp_path):
    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    (tmp_path / "a" / "SKILL.md").write_text("one\ntwo")
    (tmp_path / "a" / "node_modules" / "x.js").write_text("x")
    root = f"file:{tmp_path}"
    left, pruned = corpus.prune(corpus.scan_files(spark, str(tmp_path)), root)
    docs = corpus.documents_of(corpus.decode(left))
    assert [(r.line, r.text) for r in corpus.explode_lines(docs).orderBy("line").collect()] == [(1, "one"), (2, "two")]
    assert [r.reason for r in pruned.collect()] == ["vendored_dir"]


def test_lines_equal_splitlines(spark):
    rng = random.Random(7)
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "a", "b ", "é"]
    texts = ["".join(rng.choice(breaks) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in corpus.explode_lines(docs).collect():
        got.setdefault(r.doc_id, {})[r.line] = r.text
    for i, text in enumerate(texts):
        assert [got.get(i, {}).get(n + 1) for n in range(len(got.get(i, {})))] == text.splitlines(), repr(text)


def test_spread_leaves_large_inputs_alone(spark):
    small = spark.range(10).select("id")
    assert corpus.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 10_000, 1, 2 * spark.sparkContext.defaultParallelism)
    assert corpus.spread(wide).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_risk_needs_coverage(spark):
    scored = spark.createDataFrame([("a", 0), ("b", 60)], "t string, score int").withColumn("risk_level", sc.level_of(F.col("score")))
    cover = spark.createDataFrame([("a", "partial"), ("b", "partial"), ("c", "full")], "t string, coverage_status string")
    rows = {r.t: r.risk_level for r in sc.risk_with_coverage(scored, cover, ["t"]).collect()}
    assert rows == {"a": "UNKNOWN", "b": "HIGH", "c": "SAFE"}


def test_code_units_behind_a_mark_are_checked_in_pairs(spark):
    """Halves of a pair alone, swapped or cut, units past the last code point and odd ends: binary; all else decodes as Python does."""
    units = [0x41, 0xDF, 0x0A, 0xD7FF, 0xE000, 0xFFFD, 0xD800, 0xDBFF, 0xDC00, 0xDFFF, 0xDD41, 0x41DD, 0xD8D8]
    bodies = [b"".join(u.to_bytes(2, "big") for u in (a, b, c)) for a in units for b in units for c in (0x41, 0xD83D, 0xDE00)]
    points = [0x41, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFFFF, 0x10000, 0xFD800, 0x10FFFF, 0x110000, 0x1000041, 0xD8000041]
    rows = []
    for at, body in enumerate(bodies):
        for name, mark, swap in (("utf-16-be", b"\xfe\xff", 1), ("utf-16-le", b"\xff\xfe", 2)):
            units2 = body if swap == 1 else b"".join(body[i:i + 2][::-1] for i in range(0, len(body), 2))
            rows.append((f"{name}{at}.md", mark + units2 + (b"\x00A" if swap == 1 else b"A\x00"), name))
    for at, (a, b) in enumerate([(a, b) for a in points for b in points]):
        for name, order, mark in (("utf-32-be", "big", b"\x00\x00\xfe\xff"), ("utf-32-le", "little", b"\xff\xfe\x00\x00")):
            rows.append((f"{name}{at}.md", mark + a.to_bytes(4, order) + b.to_bytes(4, order), name))
    rows += [("odd.md", b"\xff\xfeA\x00B", "utf-16-le"), ("odd4.md", b"\x00\x00\xfe\xff\x00\x00\x00A\x00", "utf-32-be")]

    def said(body, name):
        try:
            return body[4 if "32" in name else 2:].decode(name)
        except UnicodeDecodeError:
            return None

    files = spark.createDataFrame([(path, len(body), bytearray(body)) for path, body, _ in rows], "path string, length long, content binary")
    got = {r.path: (r.text, r.skip_reason) for r in corpus.decode(files).collect()}
    for path, body, name in rows:
        want = said(body, name)
        text, reason = got[path]
        assert (text is None, reason) == ((True, "binary") if want is None else (False, None)), (path, body, want)
        assert want is None or text.lstrip("\ufeff") == want, (path, body)


def test_a_filter_on_the_text_does_not_decode_again(spark):
    """The patterns that check code units occur once in the plan, though a filter reads the text."""
    files = spark.createDataFrame([("a.md", 3, bytearray(b"abc"))], "path string, length long, content binary")
    plan = corpus.decode(files).where("text IS NOT NULL").select("path", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("make_valid_utf8") + plan.count("makeValid") <= 1, plan
