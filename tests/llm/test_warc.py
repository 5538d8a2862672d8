import base64
import hashlib
from collections import Counter

from wardlight.llm import warc
from wardlight.llm.common import Scratch

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"


def digest(html):
    return base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


def expected(pages):
    top = {}
    for p, _, h in pages:
        h = h or ""
        top[h] = p if top.get(h) is None else max(top[h], p if p is not None else top[h])
    out = Counter()
    for p, _, h in pages:
        h = h or ""
        later = top[h] is not None and p != top[h]
        out[(p, len(h.encode()), digest(h), "revisit" if later else "response", top[h] if later else None)] += 1
    return out


def trip(spark, pages, parts=3):
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts)
    rows = warc.round_trip(table, Scratch(spark, "t")).collect()
    assert all(r["intact"] for r in rows)
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)


def test_round_trip_with_magic_in_payloads(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i % 7} é漢🙂</p>" * (i % 5)) for i in range(60)]
    pages += [(100, "u", FAKE), (101, "u", "x" + FAKE * 3 + "tail"), (102, "u", "WARC/1.1\r\n"), (103, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: x\r\n\r\n")]
    pages += [(104, "u", "\r\n\r\n" + FAKE), (105, "u", FAKE[:-4]), (106, "u", "WWARC/1.1\r\nWARC/1.1\r\nWARC/1.1\r\n" + FAKE + "\r\n\r\n" + FAKE)]
    for parts in (1, 4):
        assert trip(spark, pages, parts) == expected(pages)


def test_awkward_pages(spark):
    pages = [
        (1, None, None), (2, "a b\r\nInjected: yes\tü", ""), (None, "u", "no id"), (5, "u", "same"), (5, "u", "same"), (4, "u", "same"), (6, "u", "y" * 200_000 + "é"),
        (7, "u", "\x00\x01 control"), (None, "u", "same"),
    ]
    assert trip(spark, pages) == expected(pages)
    assert trip(spark, []) == Counter()


def test_small_files_and_small_splits(spark):
    scratch = Scratch(spark, "t")
    pages = [(i, f"http://h/{i}", ("<p>text %d</p>" % i) * 50 + (FAKE if i % 4 == 0 else "")) for i in range(200)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    warc.write_archives(warc.plan_records(table), scratch.path("archives"), records_per_file=30, codec="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = warc.read_archives(spark, scratch.path("archives"), scratch).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 20))
    assert len(rows) == 200 and len({r["file"] for r in rows}) >= 6
    assert {r["payload_digest"] for r in rows} == {digest(h) for _, _, h in pages}
    assert {r["record"] for r in rows} == {f"<urn:page:{i}>" for i in range(200)}


def test_only_payloads_of_least_bytes_are_revisited(spark):
    table = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    rows = warc.round_trip(table, Scratch(spark, "t"), least_bytes=3).collect()
    assert {r["page_id"]: r["refers_to"] for r in rows} == {1: None, 2: None, 3: 4, 4: None}
