"""Language identification as multilingual mixture inference.

Every language has a model of letter trigrams (with word edges), counted over all texts that may
be learned from and hashed into ``BUCKETS``. A text is a mixture of languages whose units are its
words: expectation-maximisation over the words' trigram likelihoods gives the language
proportions. Language sets grow in the order of the full mixture's proportions for as long as
log likelihood - penalty * (languages - 1) * ln(words) rises; the proportions are those of the
chosen set. The prediction is the language of the largest proportion, the score that proportion.

The model is bounded by the number of distinct languages, at most ``MAX_LANGUAGES``; more is an
error, not a cut. Defined results: null texts and texts without a letter get ``und`` and score 0,
as do all texts when there is nothing to learn from. Ties go to the first language by name.
Repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import fold, sum_arrays, table

BUCKETS, MAX_LANGUAGES = 1 << 16, 1000
SMOOTHING, PENALTY, ROUNDS = 0.5, 1.0, 8
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_GROUP, _HELD = 200_000, 80_000


def letters_of(text: str | None) -> list[str]:
    """Runs of letters (category L); other numerals than decimal digits count as word signs, but not as letters."""
    words = _LETTERS.findall(text.lower()) if text else []
    if "".join(words).isalpha():
        return words
    return [part for word in words for part in ([word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split())]


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, word it belongs to); a word counts with a space on either side."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(points == 32) - 1
    mixed = points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)
    mixed ^= mixed >> np.uint64(15)
    mixed *= np.uint64(0x2C1B3C6D)
    inside = points[1:-1] != 32
    return ((mixed >> np.uint64(12)) % np.uint64(BUCKETS))[inside].astype(np.int64), word[1:-1][inside]


def _count(languages: dict[str, int]) -> Callable:
    def fill(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        held: dict[int, Counter] = {}

        def add() -> None:
            for language, words in held.items():
                bucket, word = _trigrams(list(words))
                weight = np.fromiter(words.values(), np.float64, len(words))[word]
                total[language * BUCKETS : (language + 1) * BUCKETS] += np.bincount(bucket, weight, minlength=BUCKETS)
            held.clear()

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = letters_of(text.as_py())
                if words and language in languages:
                    found = held.setdefault(languages[language], Counter())
                    found.update(words)
                    if len(found) > _HELD:
                        add()
        add()

    return fill


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x BUCKETS


def train(docs: DataFrame, lang: str = "lang", text: str = "text", where: Column | None = None) -> Model:
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.filter(where) if where is not None else rows
    found = [r[0] for r in rows.select(lang).distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(found)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32))
    counts = sum_arrays(rows.select(lang, text), _count({x: i for i, x in enumerate(languages)}), len(languages) * BUCKETS).reshape(-1, BUCKETS)
    share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return Model(languages, np.log(share).astype(np.float32))


def _mixture(likely: np.ndarray, starts: np.ndarray, text: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) per text by EM from ``start``; ``likely`` is words x languages, scaled by word."""
    sizes = np.diff(np.concatenate([starts, [len(text)]]))[:, None]
    share = start / start.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = likely * share[text]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(part, starts, axis=0) / sizes
    total = np.log(np.maximum((likely * share[text]).sum(axis=1), 1e-30))
    return share, np.add.reduceat(total, starts)


def infer(model: Model, texts: list[list[str]], penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, chosen set) of texts that all have words."""
    flat = [w for words in texts for w in words]
    numbers: dict[str, int] = {}
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for w in flat), np.int64, len(flat))
    bucket, owner = _trigrams(list(numbers))
    known = np.zeros((len(numbers), len(model.languages)), np.float32)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    known[owner[starts]] = np.add.reduceat(model.log_p[:, bucket].T, starts, axis=0)
    likely = np.exp(known - known.max(axis=1, keepdims=True))[word]
    lengths = np.array([len(t) for t in texts])
    starts, text = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.repeat(np.arange(len(texts)), lengths)
    n = len(model.languages)
    full, _ = _mixture(likely, starts, text, np.ones((len(texts), n), np.float32), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    chosen = np.zeros((len(texts), n), np.float32)
    np.put_along_axis(chosen, order[:, :1], 1, axis=1)
    _, value = _mixture(likely, starts, text, chosen, 0)
    share, live = chosen.copy(), np.arange(len(texts))
    for size in range(2, n + 1):
        wider = np.zeros((len(live), n), np.float32)
        np.put_along_axis(wider, order[live, :size], 1, axis=1)
        rows = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in live]) if len(live) < len(texts) else slice(None)
        sub = lengths[live]
        at = np.concatenate([[0], np.cumsum(sub)[:-1]])
        got, new = _mixture(likely[rows], at, np.repeat(np.arange(len(live)), sub), wider * np.maximum(full[live], 1e-6), rounds)
        better = new - penalty * (size - 1) * np.log(sub) > value[live] - penalty * (size - 2) * np.log(sub)
        take = live[better]
        share[take], chosen[take], value[take] = got[better], wider[better], new[better]
        live = take
        if not len(live):
            break
    return share, chosen > 0


def _predict(model: Model) -> Callable:
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pred, score = [UNKNOWN] * n, np.zeros(n)
            languages: list[list[str]] = [[] for _ in range(n)]
            shares: list[list[float]] = [[] for _ in range(n)]
            group: list[tuple[int, list[str]]] = []

            def flush() -> None:
                if not group:
                    return
                got, sets = infer(model, [w for _, w in group])
                for (at, _), row, held in zip(group, got, sets):
                    best = int(np.argmax(row))
                    pred[at], score[at] = names[best], min(1.0, float(row[best]))
                    inside = [i for i in np.argsort(-row, kind="stable") if held[i]]
                    languages[at], shares[at] = [names[i] for i in inside], [float(row[i]) for i in inside]
                group.clear()

            held = 0
            for at, text in enumerate(batch.column(1)):
                words = letters_of(text.as_py()) if names else []
                if words:
                    group.append((at, words))
                    held += len(words)
                    if held > _GROUP:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(languages, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages", "shares"],
            )

    return run


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, languages and their shares, largest first."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, where=fold("doc_id") % 3 != 1)
    found = predict(docs, model)
    return found.select("doc_id", (fold("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))
