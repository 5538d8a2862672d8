import hashlib
import re
from collections import Counter

import pytest
from helpers import awkward, none_of, prose
from pyspark.sql import functions as F

from wardlight.llm import pii
from wardlight.llm import token_rollup as tr
from wardlight.llm.common import Scratch

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, source string, lang string, text string"


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}


def recount(live):
    """live: doc id -> list of (source, lang, tokenizer, text)."""
    out = {}
    for rows in live.values():
        for source, lang, tokenizer, text in rows:
            docs, tokens = out.get((source, lang, tokenizer.version), (0, 0))
            out[(source, lang, tokenizer.version)] = (docs + 1, tokens + (len(tokenizer.encoder().encode_ordinary(text)) if text else 0))
    return out


@pytest.fixture(scope="module")
def tokenizers():
    return tr.Tokenizer.named(tr.FIRST), tr.Tokenizer.named(tr.SECOND)


def test_batches_against_a_recount(spark, tokenizers):
    first, second = tokenizers
    rollup = tr.Rollup(spark, Scratch(spark, "t").path("r"))
    rows = [(i, "ab"[i % 2], None if i % 3 else "en", prose(i, 20)) for i in range(20)] + [(None, None, None, None), (3, "z", "en", "third again")]
    live = {}
    for i, s, lang, t in rows:
        live.setdefault(i, []).append((s, lang, first, t))
    assert rollup.commit(1, spark.createDataFrame(rows, DOC), None, first)
    assert totals(rollup) == recount(live)
    again = [(2, "a", "de", "now much shorter"), (50, "c", "en", "new one"), (None, "n", None, "null id revised"), (3, "z", "en", "one row now")]
    gone = spark.createDataFrame([(4,), (5,), (5,), (999,), (2,)], "doc_id long")
    live.pop(4), live.pop(5), live.pop(2)
    for i, s, lang, t in again:  # counted under the second version beside the first
        live[i] = [*live.get(i, []), (s, lang, second, t)]
    for expected in (True, False, False):  # a repeated commit changes nothing
        assert rollup.commit(2, spark.createDataFrame(again, DOC), gone, second) is expected
        assert totals(rollup) == recount(live)
    assert rollup.commit(3, None, spark.createDataFrame([(50,)], "doc_id long"), second)
    live.pop(50)
    assert rollup.commit(4, spark.createDataFrame([], DOC), None, second)
    assert rollup.commit(5, spark.createDataFrame([(50, "c", "en", "back")], DOC), None, first)
    live[50] = [("c", "en", first, "back")]
    assert totals(rollup) == recount(live)
    small = rollup.compact(Scratch(spark, "t").path("s"))
    assert totals(small) == totals(rollup) and small.committed() == rollup.committed() == [1, 2, 3, 4, 5]
    for batch in (1, 5):
        assert small.commit(batch, spark.createDataFrame(rows, DOC), None, first) is False and totals(small) == recount(live)
    assert small.commit(6, None, spark.createDataFrame([(50,)], "doc_id long"), first)
    live.pop(50)
    assert totals(small) == recount(live)


def test_late_batches_are_refused(spark, tokenizers):
    rollup = tr.Rollup(spark, Scratch(spark, "t").path("r"))
    one = lambda text: spark.createDataFrame([(1, "a", "en", text)], DOC)
    assert rollup.commit(1, one("one two three"), None, tokenizers[0]) and rollup.commit(3, one("one"), None, *tokenizers)
    before = totals(rollup)
    with pytest.raises(ValueError, match="late"):
        rollup.commit(2, one("one two"), None, tokenizers[0])
    assert totals(rollup) == before
    assert rollup.commit(4, one("one two three"), None, *tokenizers)
    assert totals(rollup) == recount({1: [("a", "en", t, "one two three") for t in tokenizers]})
    state = {(r["version"], r["docs"], r["tokens"]) for r in rollup.state().collect()}
    assert state == {(v, d, t) for (_, _, v), (d, t) in totals(rollup).items()}


def test_a_commit_that_died_is_overwritten(spark, tokenizers):
    rollup = tr.Rollup(spark, Scratch(spark, "t").path("r"))
    spark.createDataFrame([("a", "b", "c", 5, 5)], tr.DELTA).write.parquet(f"{rollup.folder}/deltas/batch=1")  # no marker
    assert totals(rollup) == {}
    rollup.commit(1, spark.createDataFrame([(1, "a", "en", "one two")], DOC), None, tokenizers[0])
    assert list(totals(rollup)) == [("a", "en", tr.FIRST)]


def test_history_of_the_given_tables(spark, tokenizers):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rollup = tr.history(spark, docs, labels, Scratch(spark, "t").path("r"))
    bad = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
    live = {}
    for r in docs.collect():
        text = r["text"] if (r["text"] or "").isascii() else re.sub(r"[ \t\n\x0b\f\r]+", " ", r["text"])
        if r["doc_id"] not in bad:
            live[r["doc_id"]] = [(r["source"], r["lang"], t, text) for t in tokenizers]
    assert rollup.committed() == [1, 2, 3] and totals(rollup) == recount(live)


# personal data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if fine[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs, Scratch(spark, "t")).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (text, want, got[i]["spans"])
        assert set(want) <= set(got[i]["spans"].split(",") if got[i]["spans"] else [])
        assert {k: got[i][f"n_{k}"] for k in pii.KINDS} == {k: Counter(s.split(":")[0] for s in want).get(k, 0) for k in pii.KINDS}
    return got


def test_base_spans(spark):
    card = "4539 1488 0343 6467"
    check(spark, [
        "mail a.b@c.de, x@y..z no, ..p@q.r-.s. t@u.v@w.x a@b.c_d@e.f @g.h i@.j k@l", "🙂 漢 a@b.co é 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255 1.2.3", card + f" {card}{card} {card}-1 12  {card}",
        card.replace(" ", "") + " x" + card.replace(" ", "-") + "- 4539 1488 0343 6468", "+1 (017) 555-7713 +12 3 +1(2)3-4.5 6 7 8 9 +1234567890123456 ++49 30 1234567. +1 ", None, "",
        "no@numbers.here " * 300 + card, "1 2 " * 30_000, "a.b." * 20_000 + "@x.y", "x@" + "a." * 20_000 + "z", "5" * 40_000, "+" * 1000 + "1 (" * 2000, "1.2.3.4," * 3000,
    ])


def test_random_texts(spark):
    import random

    draw = random.Random(4)
    texts = ["".join(draw.choices("0123456789.@+- ()ab%_é\n", weights=[3] * 10 + [4, 2, 2, 2, 3, 1, 1, 3, 3, 1, 1, 1, 1], k=draw.randint(0, 200))) for _ in range(400)]
    check(spark, texts + ["".join(draw.choices("45 -", weights=[9, 9, 2, 1], k=60)) for _ in range(300)])


def test_looser_spans_are_added(spark):
    texts = [f"write mail to john{i}@mail{i}.com or host 10.0.0.{i} and call phone +49 30 12345{i:02} please" for i in range(60)]
    texts += ["write mail to jane [at] mail [dot] com please", "host 10[.]1[.]2[.]3 here", "card 378282246310005 paid", "call phone (030) 555-1234 now", "number 1234567890123 here"]
    got = check(spark, texts)
    added = {i: got[i]["spans"] for i in range(60, 65)}
    assert added[60].startswith("email:14:") and added[61].startswith("ip:5:") and added[62] == "card:5:20" and added[63].startswith("phone:11:") and added[64] == ""


def test_labelers_are_weighed(spark):
    """A labeler that follows the others is found reliable, one that is always on is not."""
    rows = [("ip", 1, 1, 1)] * 80 + [("ip", 0, 0, 1)] * 80 + [("ip", 1, 0, 1)] * 5 + [("ip", 0, 1, 1)] * 5
    model = pii.reliabilities(spark.createDataFrame(rows, "kind string, shape int, known int, near int")).select("m.*").first()
    assert model["shape1"] > 0.85 and model["shape0"] < 0.15 and model["near1"] == pytest.approx(model["near0"], abs=0.05) and 0.4 < model["prior"] < 0.6


def test_pii_awkward(spark):
    docs = awkward(spark)
    got = pii.find(docs, Scratch(spark, "t")).collect()
    want = Counter((r["doc_id"], hashlib.sha256(",".join(base_spans(r["text"])).encode()).hexdigest()) for r in docs.collect())
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    assert pii.find(none_of(spark), Scratch(spark, "t")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = pii.find(docs, Scratch(spark, "t"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and F.col("x") is not None
