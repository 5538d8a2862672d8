"""Language-model scoring with a hidden Markov model over word classes.

Tokens are words of the text with A-Z lowered, then one end token. Counts are exact: tasks send
one row per distinct word of a stretch of input, Spark adds them up and the result is a table.
The ``TOP`` most frequent words are classes of their own; all others fall into ``TAIL`` classes by
their last two bytes. The latent states emit classes, a class emits its words by smoothed
count, so the model gives every token sequence a probability:

    p(text) = sum over state paths of prod p(state | state) p(class | state) p(word | class)

Baum-Welch: tasks add up the expected transitions and emissions of all training texts, in
stretches of ``STRETCH`` tokens; the driver normalises them (states x classes, bounded) and the
next round starts. Scores are exact scaled forward recursions over whole texts.

A word's count is looked up in a dictionary of at most ``FREQUENT`` frequent words (bounded, as
is a word's length there); other words join the count table, a distinct word of a text at a time.

Defined results: null is the empty text, which is one end token. Without training texts every
count is 0 and classes are equally likely. Repeated rows are scored alike; ids may be null.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import Scratch, fold, most_frequent, sum_arrays, table

STATES, ROUNDS, STRETCH = 8, 6, 64
TOP, TAIL, FREQUENT, LONGEST = 4096, 256, 1 << 17, 64
ADD, SMOOTH = 0.1, 0.05
END = b"\n"  # no word holds white space
_HELD, _BATCH = 200_000, 2000


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lowered, without the end token."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _tail(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            found.update(tokens(text.as_py()))
            found[END] += 1
            if len(found) > _HELD:
                yield out()
                found = Counter()
    yield out()


@dataclass
class Counts:
    """Exact counts: all of them as a table, the frequent ones as a dictionary."""

    table: DataFrame
    total: int
    distinct: int
    frequent: dict[bytes, int]
    classes: dict[bytes, int] = field(default_factory=dict)  # words that are classes
    tail_total: np.ndarray = field(default_factory=lambda: np.zeros(TAIL))
    tail_distinct: np.ndarray = field(default_factory=lambda: np.zeros(TAIL))

    @property
    def n_classes(self) -> int:
        return len(self.classes) + TAIL

    def base(self, n: int) -> float:
        return math.log10((n + ADD) / (self.total + ADD * (self.distinct + 1)))

    def inner(self, word: bytes, n: int) -> float:
        """log10 p(word | its class)."""
        if word in self.classes:
            return 0.0
        k = _tail(word)
        return math.log10((n + ADD) / (self.tail_total[k] + ADD * (self.tail_distinct[k] + 1)))


def count(docs: DataFrame, scratch: Scratch, text: str) -> Counts:
    rows = docs.select(F.col(text)).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.write(rows, "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    best = most_frequent(words.filter(F.octet_length("word") <= LONGEST), "n", FREQUENT).collect()
    frequent = {w: n for n, w in sorted(((r["n"], bytes(r["word"])) for r in best), key=lambda x: (-x[0], x[1]))}
    ranked = [w for w in frequent if w != END][:TOP]
    out = Counts(words, total, distinct, frequent, {w: i for i, w in enumerate([END, *ranked])})
    if ranked:
        last, least = ranked[-1], frequent[ranked[-1]]
        top = (F.octet_length("word") <= LONGEST) & ((F.col("n") > least) | ((F.col("n") == least) & (F.col("word") <= F.lit(last)))) | (F.col("word") == F.lit(END))
        tail = words.filter(~top).groupBy((F.crc32(F.substring("word", -2, 2)) % TAIL).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
        for r in tail.collect():
            out.tail_total[r["k"]], out.tail_distinct[r["k"]] = r["n"], r["v"]
    return out


def _encode(counts: Counts) -> Callable:
    """(id, train, row, text) -> classes of the tokens, what the dictionary knows of the score, and the rare words."""
    look = {w: (counts.classes.get(w, len(counts.classes) + _tail(w)), counts.base(n), counts.inner(w, n)) for w, n in counts.frequent.items()}
    first_tail = len(counts.classes)
    zero, end = counts.base(0), look.get(END, (0, counts.base(0), 0.0))
    unseen = [math.log10(ADD / (counts.tail_total[k] + ADD * (counts.tail_distinct[k] + 1))) for k in range(TAIL)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, known, base, inner, rare = [], [], [], [], [], []
            for text in batch.column(3):
                words = tokens(text.as_py())
                place, b, w_in, k_n, odd = {}, end[1], end[2], int(END in look), []
                for word, n in Counter(words).items():
                    hit = look.get(word)
                    if hit is None:
                        tail = _tail(word)
                        place[word] = first_tail + tail
                        b += n * zero
                        w_in += n * unseen[tail]
                        odd.append({"word": word, "n": n})
                    else:
                        place[word] = hit[0]
                        b += n * hit[1]
                        w_in += n * hit[2]
                        k_n += n
                one = [place[w] for w in words]
                one.append(end[0])
                classes.append(np.array(one, np.uint16).tobytes())
                sizes.append(len(one))
                known.append(k_n)
                base.append(b)
                inner.append(w_in)
                rare.append(odd)
            kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(inner, pa.float64()), pa.array(rare, kind),
                ],
                names=["id", "train", "row", "classes", "n_tokens", "n_known", "base", "inner", "rare"],
            )

    return run


_ENCODED = "id long, train boolean, row long, classes binary, n_tokens long, n_known long, base double, inner double, rare array<struct<word: binary, n: long>>"


@dataclass
class Hmm:
    start: np.ndarray  # states
    later: np.ndarray  # states, for stretches that continue a text
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states

    @classmethod
    def seeded(cls, states: int, share: np.ndarray, seed: int = 11) -> "Hmm":
        draw = np.random.default_rng(seed)
        emit = share[:, None] * np.exp(draw.standard_normal((len(share), states)))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        flat = np.full(states, 1 / states)
        return cls(flat, flat, move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))

    def expect(self, stretches: np.ndarray, opens: np.ndarray, out: "Tally") -> None:
        """Adds the expected counts of padded stretches (texts x time; the class count marks padding)."""
        n, width = stretches.shape
        emit = np.vstack([self.emit, np.ones((1, self.emit.shape[1]))]).astype(np.float32)
        move = self.move.astype(np.float32)
        seen = emit[stretches]
        alpha, scale = np.empty_like(seen), np.empty((n, width), np.float32)
        now = np.where(opens[:, None], self.start, self.later).astype(np.float32)
        for t in range(width):
            now = (now @ move if t else now) * seen[:, t]
            scale[:, t] = now.sum(1)
            now = now / scale[:, t, None]
            alpha[:, t] = now
        beta = np.ones((n, self.emit.shape[1]), np.float32)
        real = stretches < len(self.emit)
        gamma = np.empty_like(seen)
        gamma[:, -1] = alpha[:, -1]
        moved = np.zeros_like(move)
        for t in range(width - 2, -1, -1):
            ahead = seen[:, t + 1] * beta / scale[:, t + 1, None]
            moved += (alpha[:, t] * real[:, t + 1, None]).T @ ahead
            beta = ahead @ move.T
            gamma[:, t] = alpha[:, t] * beta
        out.move += moved * move
        out.start += gamma[opens, 0].sum(0)
        out.later += gamma[~opens, 0].sum(0)
        classes, weight = stretches[real], gamma[real]
        for k in range(weight.shape[1]):
            out.emit[:, k] += np.bincount(classes, weight[:, k], minlength=len(self.emit))

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each class sequence; texts advance together, the longest first."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order])
        flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        total = np.zeros(len(texts))
        now = np.tile(self.start, (len(texts), 1))
        live = len(texts)
        for t in range(lengths[0]):
            if lengths[live - 1] <= t:
                live = int(np.searchsorted(-lengths, -t, side="left"))
                now = now[:live]
            now = (now @ self.move if t else now) * self.emit[flat[starts[:live] + t]]
            scale = now.sum(1)
            now /= scale[:, None]
            total[:live] += np.log10(scale)
        out = np.empty(len(texts))
        out[order] = total
        return out


class Tally:
    """Views of one flat array: what a round of Baum-Welch adds up."""

    def __init__(self, flat: np.ndarray, states: int, classes: int):
        at = np.cumsum([states, states, states * states])
        self.start, self.later = flat[: at[0]], flat[at[0] : at[1]]
        self.move = flat[at[1] : at[2]].reshape(states, states)
        self.emit = flat[at[2] :].reshape(classes, states)

    @staticmethod
    def size(states: int, classes: int) -> int:
        return 2 * states + states * states + states * classes

    def model(self) -> Hmm:
        share = self.emit.sum(1, keepdims=True) + 1.0
        emit = self.emit + SMOOTH * len(self.emit) * share / share.sum()
        even = lambda x: (x + 0.1) / (x + 0.1).sum(-1, keepdims=True)
        return Hmm(even(self.start), even(self.later), even(self.move), emit / emit.sum(0, keepdims=True))


def _expect(model: Hmm) -> Callable:
    states, classes = len(model.start), len(model.emit)

    def fill(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        tally = Tally(total, states, classes)
        rows: list[np.ndarray] = []
        opens: list[bool] = []

        def flush() -> None:
            if rows:
                padded = np.full((len(rows), STRETCH), classes, np.int64)
                for i, row in enumerate(rows):
                    padded[i, : len(row)] = row
                model.expect(padded, np.array(opens), tally)
                rows.clear()
                opens.clear()

        for batch in batches:
            for one in batch.column(0):
                text = np.frombuffer(one.as_buffer(), np.uint16)
                for at in range(0, len(text), STRETCH):
                    rows.append(text[at : at + STRETCH])
                    opens.append(at == 0)
                if len(rows) >= _BATCH:
                    flush()
        flush()

    return fill


def baum_welch(encoded: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    model = Hmm.seeded(states, share)
    rows = encoded.filter("train").select("classes")
    for _ in range(rounds):
        model = Tally(sum_arrays(rows, _expect(model), Tally.size(states, len(share))), states, len(share)).model()
    return model


def _forward(model: Hmm) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(c.as_buffer(), np.uint16) for c in batch.column(1)]
            value = model.log10(texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], names=["row", "hmm"])

    return run


def score(docs: DataFrame, scratch: Scratch, train: Column, id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score; learns from rows where ``train``."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    counts = count(rows.filter("train"), scratch, "text")
    share = np.concatenate([np.array([counts.frequent.get(w, 0) for w in counts.classes], float), counts.tail_total]) + ADD
    numbered = rows.select("id", "train", F.monotonically_increasing_id().alias("row"), "text")
    encoded = scratch.write(numbered.mapInArrow(_encode(counts), _ENCODED), "encoded")
    model = baum_welch(encoded, share / share.sum(), states, rounds)
    rare = encoded.select("row", F.explode("rare").alias("rare")).select("row", "rare.word", F.col("rare.n").alias("times"))
    met = rare.join(counts.table, "word").withColumn("gain", F.col("times") * F.log10((F.col("n") + ADD) / ADD))
    met = met.groupBy("row").agg(F.sum("times").alias("met"), F.sum("gain").alias("gain"))
    hmm = encoded.select("row", "classes").mapInArrow(_forward(model), "row long, hmm double")
    slim = encoded.drop("classes", "rare", "train")
    gain = F.coalesce("gain", F.lit(0.0))
    return slim.join(met, "row", "left").join(hmm, "row").select(
        F.col("id").alias("doc_id"), "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"), (F.col("hmm") + F.col("inner") + gain).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, Scratch(spark, "hmm"), fold("doc_id") % 10 != 0)
    return found.select("doc_id", (fold("doc_id") % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
