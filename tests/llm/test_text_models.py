import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import awkward, none_of, prose
from pyspark.sql import functions as F

from wardlight.llm import hmm_lm, mixture_langid, toxicity
from wardlight.llm.common import Scratch

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str("" if i is None else i).encode()) % n


# toxicity


@pytest.fixture(scope="module")
def channel(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    return toxicity.Channel(toxicity.character_counts(docs, "text"))


@pytest.mark.parametrize(
    "seen, word",
    [("1d10t", "idiot"), ("st00pid", None), ("s.c.u.m", "scum"), ("idiooooot", "idiot"), ("m0r0n", "moron"), ("l0$er", "loser"), ("cl*wn", "clown"), ("Trash!!!", "trash"), ("p@thet1c", "pathetic"), ("%%%idiot%%%", "idiot")],
)
def test_restored_words(channel, seen, word):
    words = channel.words(f"the and {seen} of")
    assert word is None or word in words
    assert {"the", "and", "of"} <= words


def test_spaced_letters(channel):
    assert "scum" in channel.words("that the s c u m of")
    assert channel.words("plain words, only; here") == {"plain", "words", "only", "here"}
    assert channel.words(None) == channel.words("") == channel.words(" 12 34 ") == set()


@pytest.mark.parametrize(
    "seen, word",
    [("iidiot", "idiot"), ("mmoorroonn", "moron"), ("id-iot", "idiot"), ("i.di.ot", "idiot"), ("1d-10t", "idiot"), ("mo.r0n", "moron"), ("id iot", "idiot"), ("mor on", "moron"), ("i di ot", "idiot")],
)
def test_doubled_letters_and_inner_separators(channel, seen, word):
    words = channel.words(f"the and {seen} of")
    assert word in words and {"the", "and"} <= words


def test_best_path_is_the_best_of_all_paths(channel):
    seen = "1d1o"
    paths = {}
    for a, c in product("il", "il"):
        word = a + "d" + c + "o"
        score, context = 0.0, " "
        for letter, sign in zip(word, seen):
            score += channel.log_p(context, letter) + (toxicity._SIGN if sign in toxicity.LEET else 0.0)
            context = (context + letter)[-(toxicity.ORDER - 1) :]
        paths[word] = score + channel.log_p(context, " ")
    assert channel.decode(seen) == max(paths, key=paths.get)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.with_score(docs.select("doc_id", "text"), labels, Scratch(spark, "t")).join(labels, "doc_id").collect()
    held = [(r["score"] >= 0.7, r["toxic"] == 1) for r in scored if fold(r["doc_id"], 3) == 1]
    assert len(held) > 1000 and sum(a == b for a, b in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (7, 0), (5, 0)], "doc_id long, toxic int")
    got = toxicity.with_score(docs, labels, Scratch(spark, "t"), "toxicity")
    assert got.columns == [*docs.columns, "toxicity"] and got.count() == docs.count()
    assert toxicity.keep_clean(docs, labels, Scratch(spark, "t")).columns == docs.columns
    none = toxicity.with_score(docs, labels.limit(0), Scratch(spark, "t"), "toxicity")
    assert {r["toxicity"] for r in none.collect()} == {0.0}
    assert toxicity.with_score(none_of(spark), labels, Scratch(spark, "t"), "toxicity").count() == 0


# languages


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = mixture_langid.train(docs, where=F.expr("crc32(cast(doc_id as string)) % 3 != 1"))
    got = {r["doc_id"]: r for r in mixture_langid.predict(docs, model).collect()}
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs.collect() if fold(r["doc_id"], 3) == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_mixture_of_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = mixture_langid.train(docs)
    by = {}
    for r in docs.filter("n_chars > 800").orderBy("doc_id").collect():
        by.setdefault(r["lang"], mixture_langid.letters_of(r["text"])[:100])
    mixed = " ".join(by["en"][:75] + by["de"][:25])
    rows = spark.createDataFrame([(1, mixed), (2, " ".join(by["fr"])), (3, "12 ... !!"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in mixture_langid.predict(rows, model).collect()}
    assert got[1]["lang_pred"] == "en" and set(got[1]["languages"][:2]) == {"en", "de"} and got[1]["score"] == pytest.approx(0.75, abs=0.08)
    assert got[2]["languages"][0] == "fr" and got[2]["score"] > 0.9
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (3, 4, 5)] == [("und", 0.0)] * 3


def test_mixture_agrees_with_plain_em():
    draw = np.random.default_rng(1)
    likely = draw.random((50, 3)).astype(np.float32)
    share, _ = mixture_langid._mixture(likely, np.array([0, 20]), np.repeat([0, 1], [20, 30]), np.ones((2, 3), np.float32), 5)
    for part, (a, b) in enumerate([(0, 20), (20, 50)]):
        p = np.full(3, 1 / 3)
        for _ in range(5):
            r = likely[a:b] * p
            p = (r / r.sum(1, keepdims=True)).mean(0)
        assert np.allclose(p, share[part], atol=1e-5)


def test_language_awkward(spark):
    docs = awkward(spark)
    model = mixture_langid.train(docs)
    assert mixture_langid.predict(docs, model).count() == docs.count()
    nothing = mixture_langid.train(none_of(spark))
    assert {r["lang_pred"] for r in mixture_langid.predict(docs, nothing).collect()} == {"und"}
    assert mixture_langid.predict(none_of(spark), model).count() == 0


# hidden Markov model


def small_model(states=3, classes=5, seed=2):
    share = np.random.default_rng(seed).random(classes)
    return hmm_lm.Hmm.seeded(states, share / share.sum(), seed)


def test_forward_is_the_sum_over_paths():
    model = small_model()
    texts = [np.array(t, np.uint16) for t in ([0], [1, 4, 2], [3, 3, 0, 1], [2, 1])]
    for text, got in zip(texts, model.log10(texts)):
        total = 0.0
        for path in product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
            total += p
        assert got == pytest.approx(math.log10(total))


def test_expected_counts_are_the_sums_over_paths():
    model = small_model()
    rows = [[1, 4, 2, 0], [3, 3, 5, 5], [2, 1, 1, 5]]
    opens = np.array([True, False, True])
    flat = np.zeros(hmm_lm.Tally.size(3, 5))
    tally = hmm_lm.Tally(flat, 3, 5)
    model.expect(np.array(rows), opens, tally)
    move, emit, start = np.zeros((3, 3)), np.zeros((5, 3)), np.zeros(3)
    for row, opened in zip(rows, opens):
        text = [c for c in row if c < 5]
        weights = {}
        for path in product(range(3), repeat=len(text)):
            p = (model.start if opened else model.later)[path[0]] * model.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
            weights[path] = p
        total = sum(weights.values())
        for path, p in weights.items():
            if opened:
                start[path[0]] += p / total
            for t, c in enumerate(text):
                emit[c, path[t]] += p / total
                if t:
                    move[path[t - 1], path[t]] += p / total
    assert np.allclose(tally.move, move, atol=1e-4) and np.allclose(tally.emit, emit, atol=1e-4) and np.allclose(tally.start, start, atol=1e-4)


def test_classes_and_words_add_up_to_one(spark):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(30)], "doc_id long, text string")
    counts = hmm_lm.count(docs, Scratch(spark, "t"), "text")
    by_class = Counter()
    for word, n in counts.frequent.items():
        by_class[counts.classes.get(word, len(counts.classes) + hmm_lm._tail(word))] += 10 ** counts.inner(word, n)
    for k, total in by_class.items():
        unseen = 0 if k < len(counts.classes) else 0.1 / (counts.tail_total[k - len(counts.classes)] + 0.1 * (counts.tail_distinct[k - len(counts.classes)] + 1))
        assert total + unseen == pytest.approx(1.0)


def brute_base(rows, trains):
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    count = Counter()
    for words, train in zip(tokens, trains):
        if train:
            count.update(words)
    n, v = sum(count.values()), len(count)
    return [(len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for w in tokens], n


def test_base_score_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "FREQUENT", 40)  # most words take the join
    monkeypatch.setattr(hmm_lm, "TOP", 10)
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    trains = [fold(i, 10) != 0 for i, _ in rows]
    want, n = brute_base(rows, trains)
    got = hmm_lm.score(docs, Scratch(spark, "t"), F.expr("crc32(coalesce(cast(doc_id as string), '')) % 10 != 0"), rounds=2).collect()
    key = lambda r: (r[0], r[1], round(r[2], 6))
    assert sorted(map(key, want)) == sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = hmm_lm.score(docs, Scratch(spark, "t"), F.expr("crc32(cast(doc_id as string)) % 10 != 0")).collect()
    held = [r for r in got if fold(r["doc_id"], 10) == 0]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)


def test_scores_without_training_texts(spark):
    assert hmm_lm.score(none_of(spark), Scratch(spark, "t"), F.lit(True)).count() == 0
    got = hmm_lm.score(awkward(spark), Scratch(spark, "t"), F.lit(False), rounds=1).collect()
    assert {r["n_known"] for r in got} == {0} and all(math.isfinite(r["score"]) for r in got)


def test_sifted_lattices_score_as_all_do():
    draw = random.Random(3)
    clean, bad = [prose(i, 1) for i in range(300)], ["stupid", "moron", "idiot", "worthless"]
    counts = np.zeros(toxicity.BUCKETS + toxicity.WORDS)
    toxicity._count_grams(iter([pa.RecordBatch.from_arrays([pa.array([" ".join(clean * 5 + bad * 40)])], names=["text"])]), counts)
    share = {"=" + w: 0.9 for w in bad} | {w[:5]: 0.7 for w in bad}

    def noisy(word):
        kind = draw.randrange(6)
        if kind == 0:
            return " ".join(word)
        if kind == 1:
            return word.translate(str.maketrans("oisea", "01534"))
        if kind == 2:
            return "".join(c * draw.randint(1, 3) for c in word)
        if kind == 3:
            at = draw.randrange(1, len(word))
            return word[:at] + draw.choice([" ", "-", ".", "_", "*"]) + word[at:]
        return word if kind == 4 else draw.choice("%*#!$") + word

    plain, sifted, held = toxicity.Channel(counts), toxicity.Sifted(counts, share), 0
    risky = lambda words: {w: max(share.get(f, 0) for f in toxicity.features(w)) for w in words if any(f in share for f in toxicity.features(w))}
    for _ in range(400):
        text = " ".join(noisy(draw.choice(clean + bad * 20)) for _ in range(draw.randint(1, 12)))
        want = risky(plain.words(text))
        assert risky(sifted.words(text)) == want
        held += bool(want)
        scores = list(toxicity.score_batches(counts, share, 0.01)(iter([pd.Series([text])])))[0]
        assert scores[0] == pytest.approx(1 - 0.99 * math.prod(1 - p for p in want.values()))
    assert held > 100


def test_numerals_are_no_letters(spark):
    assert mixture_langid.letters_of("² ½ Ⅷ x² 3a ab") == ["x", "a", "ab"]
    docs = spark.createDataFrame([(i, "plain english words here", "en") for i in range(9)] + [(20, "² ½ Ⅷ", "en"), (21, "1 _ -", "en")], "doc_id long, text string, lang string")
    model = mixture_langid.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in mixture_langid.predict(docs, model).collect()}
    assert got[20] == got[21] == ("und", 0.0) and got[0][0] == "en"
