"""Toxicity behind a noisy channel: Viterbi decoding of obfuscated words, then lexical evidence.

A character model (interpolated 4-grams, counts hashed into ``BUCKETS``) is trained on the plain
words of all texts. A token that is not a plain word becomes a lattice: a sign or digit emits
the letters it may stand for, a repeated letter may be dropped, a separator inside a run of
word or between short fragments may be dropped or end a word. The best path under channel and
model costs is the restored text. A token with one path only is its own result, and so is a
frequent plain word of the corpus ("too" is no noisy "to"). What is rejoined or loses a doubled
letter counts beside what stands there. Each distinct token is decoded once per task.

Evidence is learned from labelled rows: for each restored word the smoothed share of toxic texts
among those that hold it, then the same for heads of 4 to 6 letters of the words that are no
evidence themselves, so a head speaks for a family of words and not for one. A text's score is
the noisy-or of its distinct restored words. The classifier is fitted on at most ``max_labelled``
labelled rows, chosen by a hash of the id; the character model and the scores cover all.

Defined results: null and empty texts get the base score. Labels that are null are ignored; of
several labels of one id the largest counts. Without labelled rows every score is 0. Repeated
rows are scored alike, extra columns are left alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import Scratch, fold, fresh, give_back, lean, most_frequent, sum_arrays, table

ORDER, BUCKETS = 4, 1 << 18
#: Whole words are counted in buckets of their own; a word is known from so many occurrences on and that share of all.
WORDS, LEAST_KNOWN, KNOWN = 1 << 19, 20, 1e-5
SHORT = 4  # letters at most of the fragments that are tried together
MAX_LABELLED, MAX_FEATURES, LEAST_TOXIC = 40_000, 200_000, 4
PRIOR, LEAST_EVIDENCE, THRESHOLD = 3.0, 0.6, 0.7
_MEMO, _HELD = 200_000, 80_000
#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "tl", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "il",
    "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou", "?": "aeiou",
}
SEPARATORS = " .-_*~'’/\\,:;"
_SIGN, _KEEP, _DROP_REPEAT, _DROP_SEPARATOR, _BREAK, _WILD = -1.0, -4.0, -1.5, -0.5, -1.5, -3.0
_EDGE = " .,;:!?\"'()[]{}<>«»„“”…|`´*%&$#@+-_=~/\\"
_PUNCTUATION = " .,;:!?\"'()[]{}<>«»„“”…`´"
_DECORATION = re.compile(r"([%*&$#@!~+=_-])\1{2,}")
_REPEAT, _DOUBLED = re.compile(r"(.)\1\1"), re.compile(r"(.)\1")
_CUT = re.compile(r"[ .\-_~'’/\\,:;=|\"()\[\]{}<>]+")


_P, _MIX, _MASK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


def _bucket(gram: str) -> int:
    value = 0
    for c in gram:
        value = (value * _P + ord(c) + 1) & _MASK
    value ^= value >> 29
    return ((value * _MIX) & _MASK) >> 40 & (BUCKETS - 1)


def _spot(word: str) -> int:
    """Place of a whole word's count, behind those of the n-grams."""
    return BUCKETS + (zlib.crc32(word.encode("utf-8", "surrogatepass")) & (WORDS - 1))


def _add_grams(words: list[str], counts: list[int], total: np.ndarray) -> None:
    """Adds the n-grams of words, each with a space on either side, as often as the word occurs.

    The words stand in one text, so neighbours share a space; n-grams with a space inside are of no word.
    """
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = points == 32
    weight = np.append(np.asarray(counts, np.float64), 0.0)[np.cumsum(space) - 1]
    value, inside = np.zeros(len(points), np.uint64), np.ones(len(points), bool)
    for width in range(1, ORDER + 1):
        n = len(points) - width + 1
        if n <= 0:
            break
        value = value[:n] * np.uint64(_P) + points[width - 1 :] + np.uint64(1)
        if width > 2:
            inside = inside[:n] & ~space[width - 2 : width - 2 + n]
        mixed = (value ^ (value >> np.uint64(29))) * np.uint64(_MIX)
        spot = ((mixed >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        total += np.bincount(spot[inside[:n]], weight[:n][inside[:n]], minlength=BUCKETS)
    total[0] += weight.sum()


def _count_grams(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
    """Adds the n-gram counts, over the distinct plain words of each stretch."""
    tokens: Counter = Counter()

    def add() -> None:
        plain = [(token.strip(_EDGE), n) for token, n in tokens.items()]
        plain = [(word, n) for word, n in plain if word.isalpha()]
        if plain:
            _add_grams([w for w, _ in plain], [n for _, n in plain], total[:BUCKETS])
            np.add.at(total, [_spot(w) for w, _ in plain], [n for _, n in plain])
        tokens.clear()

    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            if text:
                tokens.update(text.lower().split())
                if len(tokens) > _HELD:
                    add()
    add()


def lattice(sign: str) -> list[tuple[str, float]]:
    """What a sign may stand for, and its cost under the channel."""
    if sign.isalpha():
        return [(sign, 0.0)]
    letters = LEET.get(sign, "")
    options = [(x, _SIGN if len(letters) < 4 else _WILD) for x in letters]
    if sign in SEPARATORS:
        return [*options, ("", _DROP_SEPARATOR), (" ", _BREAK)]
    return [*options, (sign, _KEEP) if sign.isdigit() else ("", _WILD)]


class Channel:
    """Restores tokens; ``words`` gives the restored words of a text."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.grams, self.tokens = counts, {}, {}
        self.kinds, self.joined = {}, {}

    def known(self, word: str) -> bool:
        """Whether a plain word is frequent in the corpus."""
        return self.counts[_spot(word)] >= max(LEAST_KNOWN, KNOWN * self.counts[0])

    def plain(self, word: str) -> tuple[str, ...]:
        """A word of letters, and what it is without doubled ones unless it is frequent as it stands."""
        if not _DOUBLED.search(word) or self.known(word):
            return (word,)
        return (word, *self.decode(word).split())

    def log_p(self, context: str, letter: str) -> float:
        key = context + letter
        found = self.grams.get(key)
        if found is None:
            p, counts = 1e-5, self.counts
            for width in range(1, ORDER + 1):
                if width - 1 > len(context):
                    break
                head = context[len(context) - width + 1 :]
                below = counts[_bucket(head)] if head else max(counts[0], 1.0)
                p = (counts[_bucket(head + letter)] + 4.0 * p) / (below + 4.0)
            if len(self.grams) > _MEMO:
                self.grams.clear()
            found = self.grams[key] = math.log(min(max(p, 1e-9), 1.0))
        return found

    def decode(self, seen: str) -> str:
        """The best path of the lattice of ``seen``; a state is the last letters of a path."""
        states: dict[str, tuple[float, str]] = {" ": (0.0, "")}
        before = ""
        for sign in seen:
            options = lattice(sign)
            if sign == before and sign not in SEPARATORS:
                options.append(("", _DROP_REPEAT))
            new: dict[str, tuple[float, str]] = {}
            for context, (score, path) in states.items():
                for letter, cost in options:
                    if letter == "" or (letter == " " and context.endswith(" ")):
                        state, total, out = context, score + cost, path
                    else:
                        state = (context + letter)[-(ORDER - 1) :]
                        total, out = score + cost + self.log_p(context, letter), path + letter
                    if state not in new or total > new[state][0]:
                        new[state] = (total, out)
            states, before = new, sign
        ends = [(score + (0.0 if c.endswith(" ") else self.log_p(c, " ")), path) for c, (score, path) in states.items()]
        return max(ends)[1].strip()

    def token(self, token: str) -> tuple[str, ...]:
        """Restored words of one lower-cased token."""
        found = self.tokens.get(token)
        if found is None:
            if len(self.tokens) > _MEMO:
                self.tokens.clear()
            found = self.tokens[token] = self._token(token)
        return found

    def _token(self, token: str) -> tuple[str, ...]:
        repeats = _REPEAT.search(token) is not None
        if token.isalpha() and not repeats:
            return self.plain(token)
        plain = _DECORATION.sub(" ", token)
        out: list[str] = []
        for piece in plain.split():
            bare = piece.strip(_EDGE)
            if bare.isalpha() and not _REPEAT.search(bare):
                out += self.plain(bare)
                sign = piece.strip(_PUNCTUATION)
                if sign != bare and len(sign) > 2:  # a sign at the edge may be a letter
                    out += self.decode(sign).split()
                continue
            parts = [p for p in _CUT.split(bare) if p]
            if len(parts) > 2 and all(len(p) == 1 for p in parts):
                out += self.decode(bare).split()
                continue
            if len(parts) > 1 and any(c.isalpha() for c in bare):  # separators inside a word
                out += self.decode(bare).split()
            if len(parts) > 1 and all(p.isalpha() and not _REPEAT.search(p) for p in parts):
                out += [w for p in parts for w in self.plain(p)]
            elif any(c.isalpha() or c in "@$!|" for c in bare):
                for part in parts:
                    out += (self.decode(part).split() if any(c.isalpha() for c in part) else [])
        return tuple(w for w in out if w)

    def runs(self, tokens: list[str]) -> Iterator[str]:
        """Restored words of runs of three and more single characters."""
        run: list[str] = []
        last = -2
        for at in [i for i, t in enumerate(tokens) if len(t) == 1]:
            if at != last + 1:
                if len(run) > 2:
                    yield from self.decode(" ".join(run)).split()
                run = []
            run.append(tokens[at])
            last = at
        if len(run) > 2:
            yield from self.decode(" ".join(run)).split()
        yield from self.fragments(tokens)

    def kind(self, token: str) -> int:
        """0: too long or without letters, 1: a short frequent word or a single sign, 2: another short fragment."""
        found = self.kinds.get(token)
        if found is None:
            bare = token.strip(_EDGE)
            if len(token) == 1:
                found = 1
            elif len(bare) > SHORT or not any(c.isalpha() for c in bare):
                found = 0
            else:
                found = 1 if bare.isalpha() and self.known(bare) else 2
            if len(self.kinds) > _MEMO:
                self.kinds.clear()
            self.kinds[token] = found
        return found

    def fragments(self, tokens: list[str]) -> Iterator[str]:
        """Restored words of neighbouring short fragments, with and without the short tokens before and after them."""
        known, short = self.kinds, {}
        for token in set(tokens):
            if len(token) <= SHORT + 4:
                kind = known.get(token)
                kind = self.kind(token) if kind is None else kind
                if kind:
                    short[token] = kind
        twos = {token for token, kind in short.items() if kind == 2}
        if not twos:
            return
        last = -1
        spots = [at for at, token in enumerate(tokens) if token in twos]
        for at in spots:
            if at < last:
                continue
            last = at + 1
            while last < len(tokens) and tokens[last] in twos:
                last += 1
            firsts = (at, at - 1) if at and tokens[at - 1] in short else (at,)
            lasts = (last, last + 1) if last < len(tokens) and tokens[last] in short else (last,)
            for a in firsts:
                for b in lasts:
                    if b - a > 1:
                        yield from self.rejoined(" ".join(t.strip(_EDGE) or t for t in tokens[a:b]))

    def rejoined(self, seen: str) -> list[str]:
        found = self.joined.get(seen)
        if found is None:
            if len(self.joined) > _MEMO:
                self.joined.clear()
            found = self.joined[seen] = self.decode(seen).split()
        return found

    def words(self, text: str | None) -> set[str]:
        """Distinct restored words, runs of single letters included."""
        tokens = text.lower().split() if text else []
        found: set[str] = set()
        for token in set(tokens):
            found.update(self.token(token))
        found.update(self.runs(tokens))
        return found


class Sifted(Channel):
    """A channel that restores only what may hold evidence: scores are the same, most lattices are never searched.

    The words and heads that are evidence form a trie. A lattice none of whose paths spells one of them from a
    word's start has no path that matters, so its best path is not looked for.
    """

    def __init__(self, counts: np.ndarray, evidence: Iterable[str]):
        super().__init__(counts)
        self.trie: dict = {}
        self.letters: dict[str, list[str]] = {}
        for feature in evidence:
            node = self.trie
            for letter in feature.lstrip("="):
                node = node.setdefault(letter, {})
            node[""] = {}

    def decode(self, seen: str) -> str:
        return super().decode(seen) if self.may_tell(seen) else ""

    def may_tell(self, seen: str) -> bool:
        live, dead, before = [self.trie], False, ""
        for sign in seen:
            letters = self.letters.get(sign)
            if letters is None:
                letters = self.letters[sign] = [letter for letter, _ in lattice(sign)]
            new = []
            for letter in letters:
                if letter == "":
                    new += live
                elif letter == " ":
                    if dead or live:
                        new.append(self.trie)
                else:
                    for node in live:
                        child = node.get(letter)
                        if child is not None:
                            if "" in child:
                                return True
                            new.append(child)
            if sign == before and sign not in SEPARATORS:
                new += live
            dead, before = True, sign
            live = new if len(new) < 2 else list({id(node): node for node in new}.values())
            if not live and not any(c in SEPARATORS for c in seen):
                return False
        return False


HEADS = (4, 5, 6)


def heads(words: Iterable[str]) -> set[str]:
    return {word[:width] for word in words for width in HEADS if len(word) >= width}


def features(word: str) -> list[str]:
    return ["=" + word, *heads([word])]


def _restored(counts: np.ndarray) -> Callable:
    """(text, toxic) -> (distinct restored words, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(counts)
        for batch in batches:
            words = [list(channel.words(text.as_py())) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(1)], names=["words", "toxic"])

    return run


def _counter(known: set[str] | None, done: set[str] | None) -> Callable:
    """Texts per feature, by task; only ``known`` features where given. With ``done``, heads of the words that are not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["feature", "n"])

        for batch in batches:
            for words in batch.column(0).to_pylist():
                seen = {"=" + w for w in words} if done is None else heads(w for w in words if "=" + w not in done)
                found.update(seen if known is None else seen & known)
            if len(found) > _HELD:
                yield out()
                found = Counter()
        yield out()

    return run


def _shares(rows: DataFrame, scratch: Scratch, name: str, base: float, done: set[str] | None) -> dict[str, float]:
    """Smoothed share of toxic texts by feature, of features that are evidence."""

    def counted(part: str, known: set[str] | None) -> DataFrame:
        return rows.filter(part).select("words").mapInArrow(lean(_counter(known, done)), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    toxic = scratch.write(counted("toxic > 0", None).filter(F.col("n") >= LEAST_TOXIC), name)
    toxic = {r["feature"]: r["n"] for r in most_frequent(toxic, "n", MAX_FEATURES).collect()}
    clean = {r["feature"]: r["n"] for r in counted("toxic <= 0", set(toxic)).collect()}
    share = {f: (t + PRIOR * base) / (t + clean.get(f, 0) + PRIOR) for f, t in toxic.items()}
    return {f: p for f, p in share.items() if p >= LEAST_EVIDENCE}


def character_counts(docs: DataFrame, text: str) -> np.ndarray:
    return sum_arrays(docs.select(F.col(text)), _count_grams, BUCKETS + WORDS)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, id: str, text: str, label_id: str, label: str, train: Column, max_labelled: int) -> tuple[np.ndarray, dict[str, float], float]:
    """(character counts, share of toxic texts by feature, base score)."""
    counts = character_counts(docs, text)
    known = labels.filter(F.col(label).isNotNull() & train).groupBy(F.col(label_id).alias("key")).agg(F.max(label).alias("toxic"))
    n_labelled = known.count()
    if n_labelled > max_labelled:  # a seeded sample; two percent below the bound, for chance
        known = known.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(980_000 * max_labelled / n_labelled))
    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key")
    rows = scratch.write(rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(lean(_restored(counts)), "words array<string>, toxic int"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    n_toxic, n = sizes.get(True, 0), sum(sizes.values())
    if not n_toxic:
        return counts, {}, 0.0
    base = n_toxic / n
    words = _shares(rows, scratch, "words", base, None)
    return counts, words | _shares(rows, scratch, "heads", base, set(words)), base / 10


def score_batches(counts: np.ndarray, share: dict[str, float], base: float) -> Callable:
    """Batches of texts to batches of scores."""
    small = counts.astype(np.float32)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        channel, memo, nothing = Sifted(small, share), {}, ()
        starts = {f.lstrip("=")[:4] for f in share}  # of a word without such a start no feature is evidence

        def risky(word: str) -> tuple:
            if word[:4] not in starts:
                return nothing
            p = max([share.get(f, 0.0) for f in features(word)])
            return ((word, p),) if p else nothing

        for batch in batches:
            out = []
            for text in batch:
                tokens = text.lower().split() if text else []
                found = {}
                for token in set(tokens):
                    bare = token.strip(_PUNCTUATION)
                    if bare[:4] not in starts and bare.isalpha() and not _DOUBLED.search(bare):
                        continue  # restored as it stands, and no evidence
                    hits = memo.get(token)
                    if hits is None:  # a token's evidence is worked out once
                        hits = memo[token] = tuple(h for w in channel._token(token) for h in risky(w)) or nothing
                    if hits:
                        found.update(hits)
                for word in channel.runs(tokens):
                    found.update(risky(word))
                out.append(1.0 - (1.0 - base) * math.prod(1.0 - p for p in found.values()))
                if len(memo) > _MEMO:
                    memo.clear()
            yield pd.Series(out, dtype="float64")
        channel = memo = None
        give_back()

    return score


def with_score(docs: DataFrame, labels: DataFrame, scratch: Scratch, name: str = "score", id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` and its score; rows whose id folds to 1 of 3 are held out of learning."""
    model = fit(docs, labels, scratch, id, text, label_id, label, fold(label_id) % 3 != 1, max_labelled)
    return docs.withColumn(name, F.pandas_udf(score_batches(*model), "double")(F.col(text)))


def keep_clean(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, **names) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    score = fresh(docs, "wl_score")
    return with_score(docs, labels, scratch, score, **names).filter(F.col(score) < threshold).drop(score)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))
    held = fold("doc_id") % 3 == 1
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
