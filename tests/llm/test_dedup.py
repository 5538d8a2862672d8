import random
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, none_of, prose, words
from pyspark.sql import functions as F

from wardlight.llm import exact_dedup as ex
from wardlight.llm import near_dedup as nd
from wardlight.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_trie_holds_what_a_dictionary_holds():
    draw = random.Random(3)
    keys = [bytes(draw.choices(b"ab", k=draw.randint(0, 9))) for _ in range(3000)] + [b"", b"a" * 5000, b"a" * 4999 + b"b"]
    trie, plain = ex.RadixTrie(), Counter()
    for key in keys:
        node = trie.node(key)
        node[0] = node[0] or [key, 0]
        node[0][1] += 1
        plain[key] += 1
    assert {k: n for k, n in trie.records()} == dict(plain)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_awkward(spark, keep):
    docs = awkward(spark)
    got = ex.assign(docs, Scratch(spark, "t"), keep=keep).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    rank = lambda i: -1 if i is None else i
    pick = max if keep == "largest" else min
    want = Counter((i, pick(groups[t], key=rank), len(groups[t])) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    kept = ex.keep_one(docs, keep=keep)
    assert kept.columns == docs.columns
    texts = Counter(r["text"] or "" for r in kept.collect())
    assert set(texts) == set(groups) and set(texts.values()) == {1}
    assert ex.assign(none_of(spark), Scratch(spark, "t")).count() == 0


def test_exact_pieces_and_tries_spill(spark):
    rows = [(i, prose(i % 40, 30)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = ex.owners(docs, Scratch(spark, "t"), piece_bytes=2000, trie_bytes=100).collect()
    assert {(r["keep_id"], r["group_size"]) for r in found} == {(i, 10) for i in range(40)}


def test_exact_normalised(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    got = ex.assign(docs, Scratch(spark, "t"), normalise=F.lower).orderBy("doc_id").collect()
    assert [r["keep_id"] for r in got] == [1, 1, 3]
    kept = ex.keep_one(docs.withColumn("wl_key", F.array(F.col("doc_id"))), normalise=F.lower, keep="largest", piece_bytes=1, trie_bytes=1).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["wl_key"]) for r in kept] == [(2, "a B", [2]), (3, "c", [3])]


def items(text):
    w = words(text)
    if not w:
        return []
    if len(w) < 5:
        return [(tuple(w), 0)]
    seen, out = Counter(), []
    for i in range(len(w) - 4):
        s = tuple(w[i : i + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def chain(a, b):
    """Longest common subsequence by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def brute_classes(texts):
    shingles = [items(t) for t in texts]
    owner = list(range(len(texts)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            same = words(texts[i]) == words(texts[j])
            if not same and a and b:
                common = len(set(a) & set(b))
                if common >= 0.8 * (len(a) + len(b) - common):
                    c = chain(a, b)
                    same = c >= 0.8 * (len(a) + len(b) - c)
            if same:
                owner[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def edited(text, seed, n):
    draw, w = random.Random(seed), text.split()
    for _ in range(n):
        w[draw.randrange(len(w))] = "changed" + str(draw.randint(0, 99))
    return " ".join(w)


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_near_against_all_pairs(spark):
    texts = []
    for base in range(12):
        text = prose(base, 150 + 10 * base)
        texts += [text] + [edited(text, 100 * base + k, k) for k in (1, 2, 3, 6, 9)]
    texts += [edited(texts[0], 900 + k, 2) for k in range(30)]  # a large group
    half = texts[0].split()
    texts += [" ".join(half[75:] + half[:75]), " ".join(half[:75]) + " " + prose(77, 75)]  # moved parts; a shared half
    texts += [prose(500 + k, 12) + " " + prose(99, 25) for k in range(20)]  # one common passage
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["id"]: r["class_id"] for r in nd.classes(docs, Scratch(spark, "t")).collect()}
    assert same_partition([got[i] for i in range(len(texts))], brute_classes(texts))


def test_near_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    got = {r["id"]: r["class_id"] for r in nd.classes(docs, Scratch(spark, "t")).collect()}
    assert same_partition([got[r["doc_id"]] for r in rows], brute_classes([r["text"] for r in rows]))


def test_alignment_respects_order_and_band():
    a = np.arange(1, 101, dtype=np.uint64)
    assert nd.aligned(a, a, 0.8) == 1.0
    assert nd.aligned(a, np.concatenate([a[50:], a[:50]]), 0.8) == 0.0
    assert nd.aligned(a, np.concatenate([a[:95], a[:0]]), 0.8) == 0.95
    assert nd.aligned(a, a[:0], 0.8) == 0.0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x1", "x0")], "a string, b string")
    got = {r["node"]: r["comp"] for r in nd.connected(edges, Scratch(spark, "t"), "c").collect()}
    assert {got[f"{i:03}"] for i in range(61)} == {"000"} and got["x1"] == got["x0"] == "x0"


def test_near_awkward(spark):
    docs = awkward(spark)
    got = nd.classes(docs, Scratch(spark, "t")).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["id"], set()).add((r["class_id"], r["class_size"]))
    assert by[1] == by[2] == {(1, 2)} and by[3] == by[4] == by[5] == {(3, 4)} and by[6] == {(6, 1)}
    kept = nd.keep_one(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 3, 6, 7, 7, 8, 9, 10)] + [(True, 0)]
    assert nd.classes(none_of(spark), Scratch(spark, "t")).count() == 0


def test_components_against_a_search(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(330)] + [(399, i) for i in range(60)] + [(7, 7)]
    parts = nd.connected(spark.createDataFrame(edges[:200], "a long, b long"), Scratch(spark, "t"), "c")
    found = nd.merged(parts, spark.createDataFrame(edges[200:], "a long, b long"), Scratch(spark, "t"), "m").collect()
    owner = list(range(400))
    for _ in range(400):
        for a, b in edges:
            owner[a] = owner[b] = min(owner[a], owner[b])
    met = {i for a, b in edges if a != b for i in (a, b)}
    assert sorted((r["node"], r["comp"]) for r in found) == [(i, owner[i]) for i in sorted(met)]


def test_later_centres_meet_other_components_only(spark):
    """What the first centre has linked is not compared again, however many members an entry has."""
    base, scratch = prose(1, 200), Scratch(spark, "t")
    texts = [edited(base, i, 1) for i in range(60)]
    met, write = {}, scratch.write

    def counted(df, name):
        table = write(df, name)
        if name.startswith("star"):
            met[name] = table.count()
        return table

    scratch.write = counted
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["class_id"] for r in nd.classes(docs, scratch).collect()} == {0}
    assert sum(met.values()) <= 5 * len(texts)


def test_large_entries_leave_the_rounds_early(spark, monkeypatch):
    monkeypatch.setattr(nd.sj, "MANY", 3)
    monkeypatch.setattr(nd.sj, "FEW", 1)
    base = prose(1, 150)
    texts = [edited(base, i, i % 9 + 4) for i in range(40)] + [edited(base, 70 + i, 1) for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["class_id"] for r in nd.classes(docs, Scratch(spark, "t")).collect()}
    assert same_partition([got[i] for i in range(len(texts))], brute_classes(texts))
