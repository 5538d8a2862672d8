import random

import numpy as np
import pytest
from helpers import awkward, none_of, prose, words

from wardlight.llm import decontaminate as dc
from wardlight.llm.common import Scratch

SF = "/root/testdata/sf0.01"
HIT = "doc_id long, text string"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def test_bit_parallel_subsequence():
    draw = random.Random(5)
    for _ in range(300):
        a, b = [draw.randrange(6) for _ in range(draw.randint(1, 90))], [draw.randrange(-1, 6) for _ in range(draw.randint(0, 60))]
        assert dc.common_subsequence(dc._masks(np.array(a)), len(a), b) == plain_lcs(a, b)


def test_latent_space_spans_the_leading_directions(spark):
    draw = np.random.default_rng(0)
    texts = [(i, None, draw.integers(0, 30, 200).astype(np.int16).tobytes()) for i in range(40)]
    encoded = spark.createDataFrame(texts, "id long, row string, ids binary")
    idf = np.linspace(0.5, 2, 30).astype(np.float32)
    items = np.zeros((2, 30), np.float32)
    matrix = []
    for _, _, ids in texts:
        one = np.frombuffer(ids, np.int16)
        for at in range(0, 200, 64):
            matrix.append(np.bincount(one[at : at + 64], minlength=30) * idf)
    basis = dc.latent_space(encoded, idf, items, 30)
    _, _, exact = np.linalg.svd(np.array(matrix), full_matrices=False)
    assert np.abs((basis[:, :3] * exact[:3].T).sum(0)) == pytest.approx(np.ones(3), abs=2e-2)


def test_verbatim_leaks_of_given_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, items, Scratch(spark, "t")).collect()}
    held = [(r["item_id"], " " + " ".join(words(r["text"])) + " ") for r in items.collect()]
    want = set()
    for r in docs.collect():
        text = " " + " ".join(words(r["text"])) + " "
        want |= {(r["doc_id"], i) for i, item in held if item in text}
    assert got == want


def paraphrase(text, seed, share):
    draw = random.Random(seed)
    out = []
    for w in text.split():
        roll = draw.random()
        if roll < share / 2:
            continue
        out.append("otherword" if roll < share else w)
    return " ".join(out)


def test_paraphrases_and_recall_against_brute_force(spark):
    """Every item is planted with a fifth of its words dropped or replaced; all windows against all items is the brute force."""
    items = [(i, prose(3000 + i, 30 + i % 25)) for i in range(60)]
    docs = []
    for i, text in items:
        docs.append((i, prose(i, 300) + " " + paraphrase(text, i, 0.2) + " " + prose(7000 + i, 200)))
    docs += [(1000 + i, prose(9000 + i, 500)) for i in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(spark.createDataFrame(docs, HIT), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()}
    want = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            q = words(item)
            tail = q[-max(2, len(q) // 4) :]
            for at in range(0, len(w), 32):
                near = w[max(0, at - 32) : at + 96]
                if plain_lcs(q, near) >= 0.6 * len(q) and plain_lcs(tail, near) >= 0.5 * len(tail):
                    want.add((d, i))
                    break
    planted = {(i, i) for i, _ in items} & want
    assert len(planted) >= 50 and len(got & planted) >= 0.95 * len(planted)
    assert got <= want


def test_long_items_are_matched_whole(spark):
    """Verbatim and with a fifth of the words dropped or replaced, at any offset; a half of one is no match."""
    lengths = (64, 65, 100, 130, 200, 213, 250, 500, 512, 1500)
    items = [(n, prose(20_000 + n, n)) for n in lengths]
    docs = []
    for n, text in items:
        for k, shift in enumerate((0, 13, 50, 101)):
            lead = prose(21_000 + n + k, 40 + shift) + " "
            docs += [(10 * n + k, lead + text + " " + prose(22_000 + n, 90)), (100_000 + 10 * n + k, lead + paraphrase(text, n + k, 0.2) + " " + prose(23_000 + n, 90))]
        docs.append((200_000 + n, prose(24_000 + n, 70) + " " + " ".join(text.split()[: n // 2]) + " " + prose(25_000 + n, 2 * n)))
    found = dc.leaks(spark.createDataFrame(docs, HIT), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    want = {(d % 100_000 // 10, d) for d, _ in docs if d < 200_000}
    assert got == {(d, n) for n, d in want}
    assert {r["lcs"] for r in found if r["doc_id"] < 100_000} == {1.0}


def test_an_item_beyond_the_block_bounds(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(dc, "LONGEST", 256)
    items = [(1, prose(31, 300)), (2, prose(32, 1030)), (3, prose(33, 20))]
    docs = [(i, prose(600 + i, 50) + " " + text) for i, text in items] + [(9, prose(9, 400))]
    found = dc.leaks(spark.createDataFrame(docs, HIT), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_widespread_leaks(spark):
    """One contaminated document fills a third of the rows, a passage stands in every fifth of the others, an item has common words only."""
    common = [f"w{k}" for k in range(12)]
    draw = random.Random(8)

    def page(seed, n):
        return " ".join(w + " " + draw.choice(common) for w in prose(seed, n // 2).split())

    items = [(i, prose(500 + i, 15 + 12 * i)) for i in range(5)] + [(5, " ".join(draw.choice(common) for _ in range(24)))]
    copied, passage, single = items[0][1], items[1][1], items[2][1]
    copy = page(50, 90) + " " + copied + " " + items[5][1] + " " + page(51, 120)
    docs = [(i, copy) for i in range(150)]
    docs += [(1000 + i, page(1000 + i, 200 + i % 60) + (" " + passage if i % 5 == 0 else "") + " " + page(2000 + i, 100)) for i in range(300)]
    docs += [(5000, page(60, 130) + " " + copied + " " + page(61, 60)), (5001, page(62, 99) + " " + items[5][1] + " " + page(63, 60)), (5002, page(64, 77) + " " + single + " " + page(65, 60))]
    found = dc.leaks(spark.createDataFrame(docs, HIT), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    want = {(d, i) for d, text in docs for i, item in items if f" {item} " in f" {text} "}
    assert len(want) == 300 + 60 + 3 and want <= got
    assert {(d, i) for d, i in got if i != 5} == {(d, i) for d, i in want if i != 5}


def test_sums_of_frequent_and_other_words_agree():
    draw = np.random.default_rng(3)
    ids, stretch = draw.integers(-1, 40, 500).astype(np.int16), np.sort(draw.integers(0, 9, 500))
    table = draw.standard_normal((40, 6)).astype(np.float32)
    want = np.zeros((9, 6))
    np.add.at(want, stretch[ids >= 0], table[ids[ids >= 0]])
    for often in (np.zeros(0, int), np.arange(0, 40, 3), np.arange(40)):
        adder = dc._Sums(40, often)
        assert np.allclose(adder.of(table, *adder.split(ids, stretch, 9)), want, atol=1e-3)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 3)
    items = [(i, prose(40 + i, 25)) for i in range(8)]
    docs = [(i, prose(600 + i, 50) + " " + text) for i, text in items]
    found = dc.leaks(spark.createDataFrame(docs, HIT), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i in range(8)}


def test_awkward(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, prose(9, 30)), (5, prose(6, 700)), (5, prose(7, 40))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, items, Scratch(spark, "t")).collect()}
    assert {(None, None), (6, 5), (7, 5)} <= found
    kept = dc.keep_clean(docs, items, Scratch(spark, "t"))
    assert kept.columns == docs.columns and not {6} & {r["doc_id"] for r in kept.collect()}
    assert dc.keep_clean(docs, items.limit(0), Scratch(spark, "t")).count() == docs.count()
    assert dc.leaks(none_of(spark), items, Scratch(spark, "t")).count() == 0


def test_a_worker_gives_memory_back_when_a_task_is_done(monkeypatch):
    from wardlight.llm import common

    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append("back"))
    doubled = common.lean(lambda batches: (told.append(b) or 2 * b for b in batches))
    assert list(doubled(iter([1, 2]))) == [2, 4] and told == [1, 2, "back"]

    def broken(batches):
        yield next(batches)
        raise ValueError

    some = common.lean(broken)(iter([1]))
    assert next(some) == 1
    with pytest.raises(ValueError):
        next(some)
    assert told[-2:] == ["back", "back"]
    monkeypatch.undo()
    common.give_back()
