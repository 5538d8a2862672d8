import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, none_of, prose
from pyspark.sql import functions as F

from wardlight.llm import merkle, ranked_search, set_join
from wardlight.llm.common import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- Merkle manifest -------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(level):
    """Root and, for each leaf, the (before, after) texts of its runs."""
    paths, place = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, at in enumerate(place):
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            paths[i].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
            place[i] = at // 3
        level = [h("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = {}
    for r in rows:
        leaves.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, h("".join(field(r[f]) for f in merkle.FIELDS)), r["doc_id"]))
    order = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: plain_tree([one[2] for one in sorted(leaves[s])]) for s in order}
    root, tops = plain_tree([built[s][0] for s in order])
    return [(one[3], one[2], built[s][0], root, h("".join(b + a for b, a in path + tops[k]))) for k, s in enumerate(order) for one, path in zip(sorted(leaves[s]), built[s][1])]


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [4, 9, 10], [28, 1, 1, 3, 82]])
def test_manifest_equals_plain_tree(spark, sizes):
    rows = [(100 * s + i, prose(i, 3) + "\n", "en", f"s{s}" if s else None, i) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = merkle.manifest(docs, Scratch(spark, "t"))
    text = lambda c: F.lower(F.hex(c))
    got = found.select("id", text("leaf"), text("subroot"), text("root"), text(merkle.proof_digest(F.col("path"))), (merkle.folded(F.col("path"), F.col("leaf")) == F.col("root")).alias("ok")).collect()
    assert all(r["ok"] for r in got)
    assert Counter(tuple(r)[:5] for r in got) == Counter(plain_manifest(docs.collect()))


def test_manifest_of_awkward_rows(spark):
    docs = awkward(spark)
    text = lambda c: F.lower(F.hex(c))
    found = merkle.manifest(docs, Scratch(spark, "t"))
    got = found.select("id", text("leaf"), text("subroot"), text("root"), text(merkle.proof_digest(F.col("path")))).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(docs.collect()))
    assert merkle.manifest(none_of(spark), Scratch(spark, "t")).count() == 0


def test_a_changed_leaf_misses_the_root(spark):
    docs = spark.createDataFrame([(i, "a\nb", "en", "s", 3) for i in range(7)], "doc_id long, text string, lang string, source string, n_chars long")
    other = merkle.leaf([F.translate("text", "\n", "") if f == "text" else F.col(f) for f in merkle.FIELDS])
    found = merkle.manifest(docs, Scratch(spark, "t"), body=other)
    assert not found.filter(merkle.folded(F.col("path"), F.col("body")) == F.col("root")).count()


# --- Ranked search ---------------------------------------------------------------------------


def plain_search(docs, items, k=10):
    counts = [(r["doc_id"], Counter(TERMS.findall((r["text"] or "").translate(LOWER)))) for r in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length = len(counts), sum(size for *_, size in counts)
    df = Counter(term for _, c, _ in counts for term in c)
    terms = {}
    for r in items:
        terms.setdefault(r["item_id"], set()).update(TERMS.findall((r["text"] or "").translate(LOWER)))
    found = {}
    for item, wanted in terms.items():
        scored = []
        for i, c, size in counts:
            m = 10 + (90 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        found[item] = [(one[3], -one[0]) for one in sorted(scored)[:k]]
    return found


def ranked(found):
    rows = {}
    for r in found.orderBy("item_id", "rank").collect():
        rows.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(rows[r["item_id"]])
    return rows


@pytest.mark.parametrize("segment, block_terms", [(1 << 20, 1 << 20), (300, 40), (1, 10)])
def test_search_equals_plain_scores(spark, segment, block_terms):
    draw = random.Random(4)
    pool = prose(11, 120).split()
    docs = spark.createDataFrame([(i, " ".join(draw.choices(pool, k=draw.randint(0, 40))) if i % 9 else "same text in many rows", "x") for i in range(400)], "doc_id long, text string, score string").repartition(5)
    items = spark.createDataFrame([(i, " ".join(draw.choices(pool, k=draw.choice([0, 1, 3, 12, 60]))) if i else "SAME text") for i in range(25)], "item_id long, text string")
    got = ranked(ranked_search.search(docs, items, Scratch(spark, "t"), segment=segment, block_terms=block_terms))
    want = plain_search(docs.collect(), items.collect())
    assert got == {i: rows for i, rows in want.items() if rows}


def test_search_awkward(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, prose(1, 20)), (2, None), (3, ""), (4, "Ünï 漢字 1 2"), (5, "nothing here"), (1, prose(9, 30)), (None, "1")], "item_id long, text string")
    got = ranked(ranked_search.search(docs, items, Scratch(spark, "t")))
    want = {i: rows for i, rows in plain_search(docs.collect(), items.collect()).items() if rows}
    assert got == want and 4 in got and 2 not in got
    assert ranked_search.search(none_of(spark), items, Scratch(spark, "t")).count() == 0
    assert ranked_search.search(docs, items.limit(0), Scratch(spark, "t")).count() == 0


def test_reads_stop_early():
    draw = np.random.default_rng(1)
    lists = []
    for _ in range(6):  # ten documents lead every list
        values = np.sort((draw.pareto(1.1, 20_000) * 1000).astype(np.int64) + 1)[::-1]
        lists.append((np.concatenate([draw.permutation(10), 10 + draw.permutation(19_990)]), values))
    found, scores, read = ranked_search.nra(lists, 20_000, 10, 0)
    whole = np.zeros(20_000, np.int64)
    for docs, values in lists:
        whole[docs] += values
    assert read < 6 * 20_000 // 4
    assert (scores == whole[found]).all() and set(np.argsort(-whole)[:10]) <= set(found.tolist())


# --- Set join --------------------------------------------------------------------------------


def plain_components(rows, share=85):
    sets = []
    for r in rows:
        words = WORDS.findall((r["text"] or "").translate(LOWER))
        sets.append({tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(top(i), []).append(r["doc_id"])
    smallest = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return Counter((r["doc_id"], len(s), smallest[top(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


def edited(draw, words, times):
    words = list(words)
    for _ in range(times):
        at = draw.randrange(len(words))
        words[at : at + 1] = draw.choice([[], ["new" + str(draw.randrange(50))], [words[at], words[at]]])
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    draw = random.Random(seed)
    texts = []
    for size in (7, 12, 30, 80, 150, 400):  # groups of near copies at many distances, edits of edits too
        base = prose(size + seed, size).split()
        texts += [edited(draw, base, draw.randint(0, 2 + size // 12)) for _ in range(40)]
        texts += [edited(draw, texts[-1 - draw.randrange(30)].split(), 1) for _ in range(20)]
    line = prose(99, 60)
    texts += [prose(500 + i, draw.randint(1, 120)) + " " + line for i in range(60)] + [prose(i, 3) for i in range(20)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = set_join.components(docs, Scratch(spark, "t"))
    assert Counter(map(tuple, got.collect())) == plain_components(docs.collect())


def test_components_of_awkward_rows(spark):
    docs = awkward(spark)
    got = set_join.components(docs, Scratch(spark, "t"))
    assert Counter(map(tuple, got.collect())) == plain_components(docs.collect())
    assert set_join.components(none_of(spark), Scratch(spark, "t")).count() == 0


def test_any_allocation_keeps_the_links():
    draw, shingles, bands = random.Random(5), set_join.Shingles(), set_join.Bands(85)
    for turn in range(300):
        base = prose(turn, draw.randint(8, 200)).split()
        one, two = shingles.of(" ".join(base)), shingles.of(edited(draw, base, draw.randint(0, 6)))
        common = len(np.intersect1d(one, two))
        if 100 * common < 85 * (len(one) + len(two) - common) or (one.shape == two.shape and (one == two).all()):
            continue
        groups = {g: bound + 1 + set_join.slack(bound) for s in (one, two) for g, bound in bands.groups(len(s))}
        costs = {(g, i, wide): draw.choice([0, 0, 5, 1000, 10**6]) for g, n in groups.items() for i in range(n) for wide in (False, True)}
        plan = set_join.allocate(costs, {g: (10.0, 1000.0) for g in groups}, 85)
        for chosen in ({}, plan):
            assert set(set_join.entries(one, bands, chosen).tolist()) & set(set_join.entries(two, bands, chosen).tolist())


def test_difference_prefixes_meet():
    draw, shingles, met = random.Random(6), set_join.Shingles(), 0
    for turn in range(400):
        base = prose(turn, draw.randint(20, 120)).split()
        one = edited(draw, base, draw.randint(0, 9)).split()
        c, x, y = shingles.of(" ".join(base)), shingles.of(" ".join(one)), shingles.of(edited(draw, one, draw.randint(0, 4)))
        linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        if linked(x, y) and not (linked(c, x) and linked(c, y)) and len(np.setxor1d(x, y)):
            (px, _), (py, _) = set_join.difference_prefix(c, x, 85), set_join.difference_prefix(c, y, 85)
            assert len(np.intersect1d(px, py))
            met += 1
    assert met > 20


def test_marks_rule_out_no_link():
    import pyarrow as pa

    from wardlight.llm import set_join

    draw = np.random.default_rng(4)
    for n in (5, 70, 400, 9000):
        one = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        two = np.union1d(draw.choice(one, len(one) * 9 // 10, replace=False), draw.integers(0, 2**64, n // 20, dtype=np.uint64))
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([set_join.histogram(x).tobytes() for x in (one, two)], pa.binary())], names=["node", "bins"])
        found = next(set_join._marks(iter([batch])))
        marks = np.array([found.column(at).to_numpy() for at in (1, 2)]).T.copy().view(np.uint8).astype(int)
        full = np.array([np.minimum(np.bincount((x >> np.uint64(60)).astype(int), minlength=16), 255) for x in (one, two)])
        assert (marks == full).all()
        assert np.abs(marks[0] - marks[1]).sum() <= len(np.setxor1d(one, two))
