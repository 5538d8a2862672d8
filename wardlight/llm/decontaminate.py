"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are a stated query set, taken in blocks of bounded size. For a block, texts are
encoded once as numbers of the block's vocabulary; no other word can take part in a match.
Passages of ``2 * STEP`` words are weighted by TF-IDF (document frequencies over all passages).
Every word weighs something, and the rarer half of the words of an item's part at least as much
as a word in ``MOST`` of the passages: a passage that many documents share makes its own words
frequent, and it is to be found in each of them. A randomised SVD of all passages, to which
the items are added, each with the weight of the corpus, gives the latent space in one pass: tasks sum
A'A times a random matrix (vocabulary x rank, both bounded), of which the driver takes the
leading singular vectors. Windows of ``2 * STEP`` words, every ``STEP``, are projected and
compared with the items of the block, in even parts of at most as many words; those with a
cosine of ``cosine`` or more are candidates. A candidate counts when the longest common
subsequence of the whole item and the surroundings covers ``share`` of the item's words and
``answer`` of its answer, the last quarter. Surroundings reach as far as the item would if it
stood there with twice its words. Items of any length are matched, those of more than
``LONGEST`` words in even stretches of at most that, of which one that is held is enough; items
of fewer than ``LEAST`` words are left out as too common.

Defined results: null and empty texts, and texts shorter than an item, match only what they
hold. Items without text are left out. A repeated row or item gives its own rows of results. An
empty benchmark or table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import Scratch, fresh, lean, sum_arrays, table
from wardlight.llm.near_dedup import _row, words_of

STEP, LEAST, MOST = 32, 5, 0.01
RANK, COSINE, SHARE, ANSWER = 256, 0.25, 0.6, 0.5
BLOCK_ITEMS, BLOCK_WORDS, OVERSAMPLE = 256, 16_000, 16  # items count by their parts
LONGEST = BLOCK_ITEMS * 2 * STEP
OFTEN = 1024  # so many words in more than MOST of the passages are added up by matrix products, the others one by one
_PIECE, _MEMO = 100_000, 200_000  # words that are worked on at once; tokens that are remembered
_PAIR = "doc_id long, row string, item_id long, cosine double, lcs double, answer double, word long"


def _even(words: list, most: int) -> list[list]:
    """``words`` in as few stretches of at most ``most`` as there can be, of almost equal length."""
    n = -(-len(words) // most)
    ends = [len(words) * k // n for k in range(n + 1)]
    return [words[a:b] for a, b in zip(ends, ends[1:])]


def blocks(items: DataFrame, id: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Items as (id, words), in blocks of bounded vocabulary and number of parts; an item larger than the bounds is cut into stretches."""
    block: list[tuple[int, list[str]]] = []
    seen: set[str] = set()
    parts = 0
    for row in items.select(F.col(id).cast("long"), F.col(text)).orderBy(id).toLocalIterator():
        words = words_of(row[1])
        if len(words) < LEAST:
            continue
        for stretch in _even(words, LONGEST):
            more = len(_even(stretch, 2 * STEP))
            if block and (parts + more > BLOCK_ITEMS or len(seen) + len(stretch) > BLOCK_WORDS):
                yield block
                block, seen, parts = [], set(), 0
            block.append((row[0], stretch))
            seen.update(stretch)
            parts += more
    if block:
        yield block


class _Numbers(dict):
    """Numbers of the words of a lower-cased token: one number, or -2 - k for the k-th list of several or none."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary, self.lists = vocabulary, []

    def __missing__(self, token: str) -> int:
        found = [self.vocabulary.get(w, -1) for w in words_of(token)]
        if len(found) == 1:
            value = found[0]
        else:
            value = -2 - len(self.lists)
            self.lists.append(found)
        self[token] = value
        return value

    def of(self, text: str) -> np.ndarray:
        """The word numbers of a text, -1 for words outside the vocabulary."""
        numbers = np.fromiter(map(self.__getitem__, text.lower().split()), np.int32)
        odd = np.flatnonzero(numbers < -1)
        if len(odd):
            parts, last = [], 0
            for at in odd.tolist():
                parts += [numbers[last:at], self.lists[-2 - numbers[at]]]
                last = at + 1
            numbers = np.concatenate([*parts, numbers[last:]])
        return numbers.astype(np.int16)


def _encode(vocabulary: dict[str, int]) -> Callable:
    """(id, row, text) -> (id, row, ids): 16-bit word numbers, -1 for other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(vocabulary)
        for batch in batches:
            out = []
            for text in batch.column(2):
                out.append(numbers.of(text.as_py()).tobytes())
                if len(numbers) > _MEMO:
                    numbers = _Numbers(vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "row", "ids"])

    return run


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Texts of a batch as word-number arrays, in groups of bounded size: (first text, arrays)."""
    first, held, group = 0, 0, []
    for at, ids in enumerate(batch.column(column)):
        one = np.frombuffer(ids.as_buffer(), np.int16)
        group.append(one)
        held += len(one)
        if held > _PIECE:
            yield first, group
            first, held, group = at + 1, 0, []
    if group:
        yield first, group


def _flat(group: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, stretch of ``width`` words of each, first stretch of each text); stretches keep to their text."""
    lengths = np.array([len(g) for g in group])
    stretches = -(-lengths // width)
    firsts = np.concatenate([[0], np.cumsum(stretches)])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.concatenate(group) if group else np.zeros(0, np.int16)
    place = np.arange(len(ids)) - np.repeat(starts[:-1], lengths)
    return ids, np.repeat(firsts[:-1], lengths) + place // width, firsts


def _frequencies(size: int) -> Callable:
    """Adds the number of passages that hold each word; the last entry counts passages."""

    def fill(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        for batch in batches:
            for _, group in _pieces(batch, 0):
                ids, stretch, firsts = _flat(group, 2 * STEP)
                known = ids >= 0
                pairs = np.unique(stretch[known] * np.int64(size) + ids[known])
                total[:size] += np.bincount(pairs % size, minlength=size)
                total[size] += firsts[-1]

    return fill


def _rows_of(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of the rows of ``values``) for sorted keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(values, starts, axis=0)


def weights(counts: np.ndarray, passages: float, parts: list[np.ndarray]) -> np.ndarray:
    """Weight of each word by the number of passages that hold it; none is zero."""
    idf = np.log1p((passages + 1) / (counts + 1))
    least = np.log1p(1 / MOST)
    for part in parts:
        words = np.unique(part)
        rarer = words[np.argsort(counts[words], kind="stable")[: -(-len(words) // 2)]]
        idf[rarer] = np.maximum(idf[rarer], least)
    return idf.astype(np.float32)


def frequent(counts: np.ndarray, passages: float) -> np.ndarray:
    most = np.argsort(-counts, kind="stable")[:OFTEN]
    return most[counts[most] > MOST * passages]


class _Sums:
    """Sums of rows of a table over stretches of words; words in ``often`` are counted and go through one product."""

    def __init__(self, size: int, often: np.ndarray):
        self.often, self.slot = often, np.full(size, -1)
        self.slot[often] = np.arange(len(often))

    def split(self, ids: np.ndarray, stretch: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts of the frequent words by stretch, the other words, their stretches)."""
        known = ids >= 0
        ids, stretch = ids[known], stretch[known]
        slot, width = self.slot[ids], len(self.often)
        rare = slot < 0
        counts = np.bincount(stretch[~rare] * width + slot[~rare], minlength=n * width) if width else np.zeros(0)
        return counts.reshape(n, width).astype(np.float32), ids[rare], stretch[rare]

    def of(self, table: np.ndarray, counts: np.ndarray, ids: np.ndarray, stretch: np.ndarray) -> np.ndarray:
        out = counts @ table[self.often]
        if len(ids):
            keys, sums = _rows_of(table[ids], stretch)
            out[keys] += sums
        return out


def _gram(idf: np.ndarray, basis: np.ndarray, often: np.ndarray) -> Callable:
    """Adds A'A basis over all passages."""
    size, rank = basis.shape
    weighted = idf[:, None] * basis

    def fill(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        out, adder = total.reshape(size, rank), _Sums(size, often)
        for batch in batches:
            for _, group in _pieces(batch, 0):
                ids, stretch, firsts = _flat(group, 2 * STEP)
                counts, ids, stretch = adder.split(ids, stretch, firsts[-1])
                sums = adder.of(weighted, counts, ids, stretch)
                out[often] += idf[often][:, None] * (counts.T @ sums)
                if len(ids):
                    order = np.argsort(ids, kind="stable")
                    terms, gained = _rows_of(sums[stretch[order]], ids[order])
                    out[terms] += idf[terms][:, None] * gained

    return fill


def latent_space(encoded: DataFrame, idf: np.ndarray, items: np.ndarray, rank: int, often: np.ndarray = np.zeros(0, int), seed: int = 7) -> np.ndarray:
    """Orthonormal basis (words x rank) of the leading right singular vectors of passages and weighted items."""
    size, rank = len(idf), min(rank, len(items) + OVERSAMPLE)
    sketch = np.random.default_rng(seed).standard_normal((size, min(size, rank + OVERSAMPLE))).astype(np.float32)
    width = sketch.shape[1]
    seen = sum_arrays(encoded.select("ids"), _gram(idf, sketch, often), size * width).reshape(size, width)
    # each item alike, and enough for its own direction to stand beside the corpus' first
    items = items / np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-9)
    own = items.T @ (items @ sketch)
    weight = len(items) ** 0.5 * max(1.0, float(np.linalg.norm(seen)) / max(float(np.linalg.norm(own)), 1e-9))
    seen = seen + weight * own
    # one pass over the corpus: A'A = Y (S'Y)^+ Y' for Y = A'A S
    core = sketch.T.astype(np.float64) @ seen
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max() * 1e-7
    half = seen @ (vectors[:, keep] / np.sqrt(values[keep]))
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    return np.ascontiguousarray(left[:, :rank], np.float32)


def common_subsequence(masks: dict[int, int], length: int, text: list[int]) -> int:
    """Length of the longest common subsequence, one machine word per ``length`` bits of the pattern."""
    full = (1 << length) - 1
    row = full
    for one in text:
        mask = masks.get(one)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for at, word in enumerate(words.tolist()):
        out[word] = out.get(word, 0) | 1 << at
    return out


def _search(names: list[int], items: list[np.ndarray], idf: np.ndarray, basis: np.ndarray, often: np.ndarray, cosine: float, share: float, answer: float) -> Callable:
    parts = [_even(i, 2 * STEP) for i in items]
    # by part: its item, the words of the item before it and those after it
    whole = [q for q, cut in enumerate(parts) for _ in cut]
    before = [sum(map(len, cut[:k])) for cut in parts for k in range(len(cut))]
    after = [sum(map(len, cut[k + 1 :])) for cut in parts for k in range(len(cut))]
    parts = [p for cut in parts for p in cut]
    latent = np.stack([(idf[p][:, None] * basis[p]).sum(0) for p in parts])
    norms = np.array([np.sqrt(((idf[w] * n) ** 2).sum()) for w, n in (np.unique(p, return_counts=True) for p in parts)])
    # what one occurrence of a word adds to the product of a window with each part
    table = ((idf[:, None] * basis) @ (latent / norms[:, None]).T).astype(np.float32)
    tails = [i[-max(2, len(i) // 4) :] for i in items]
    distinct = [set(i.tolist()) for i in items]
    masks, ends = [_masks(i) for i in items], [_masks(t) for t in tails]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = _Sums(len(idf), often)
        for batch in batches:
            found: list[tuple] = []
            for first, group in _pieces(batch, 2):
                ids, block, firsts = _flat(group, STEP)
                counts, ids, block = adder.split(ids, block, firsts[-1])
                added = adder.of(table, counts, ids, block)
                owner = np.repeat(np.arange(len(group)), np.diff(firsts))
                # a window is a block and the next one of the same text
                alone = firsts[1:][np.diff(firsts) > 0] - 1
                ahead = np.arange(1, firsts[-1] + 1)
                ahead[alone] = firsts[-1]
                more = np.flatnonzero(ahead < firsts[-1])
                mass = np.bincount(block, idf[ids] ** 2, minlength=firsts[-1]).astype(float)
                norm = mass.copy()
                norm[more] += mass[ahead[more]]
                score = added.copy()
                score[more] += added[ahead[more]]
                pairs = counts.copy()
                pairs[more] += counts[ahead[more]]
                norm += pairs**2 @ idf[often] ** 2
                live = np.flatnonzero(norm > 0)
                score = score[live] / np.sqrt(norm[live])[:, None].astype(np.float32)
                best: dict[tuple[int, int], tuple] = {}
                near_to, part = np.nonzero(score >= cosine)
                order = np.argsort(-score[near_to, part], kind="stable")
                near_to, part = near_to[order], part[order]
                texts = owner[live[near_to]]
                starts = (live[near_to] - firsts[texts]) * STEP
                checked: set[tuple] = set()
                held: dict[tuple, set] = {}
                for w, p, text, start in zip(near_to.tolist(), part.tolist(), texts.tolist(), starts.tolist()):
                    q = whole[p]
                    # parts of an item that put its first word at the same place share one look at the surroundings
                    if before[p] or after[p]:
                        place = (text, q, (start - before[p]) // STEP)
                        if place in checked:
                            continue
                        checked.add(place)
                    look = (text, max(0, start - 2 * before[p] - STEP), start + 3 * STEP + 2 * after[p])
                    words = held.get(look)
                    if words is None:
                        words = held[look] = set(group[text][look[1] : look[2]].tolist())
                    # a word that is not there is in no common subsequence
                    if (len(items[q]) - len(distinct[q] - words)) / len(items[q]) < share:
                        continue
                    near = group[text][look[1] : look[2]].tolist()
                    covered = common_subsequence(masks[q], len(items[q]), near) / len(items[q])
                    if covered < share:
                        continue
                    told = common_subsequence(ends[q], len(tails[q]), near) / len(tails[q])
                    if told < answer:
                        continue
                    one = (covered, min(1.0, float(score[w, p])), told, -start)
                    if one > best.get((text, q), (0.0,)):
                        best[(text, q)] = one
                found += [(first + text, q, *one) for (text, q), one in best.items()]
            ids, rows = batch.column(0), batch.column(1)
            take = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(take), rows.take(take), pa.array([names[f[1]] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.float64()), pa.array([f[4] for f in found], pa.float64()), pa.array([-f[5] for f in found], pa.int64()),
                ],
                names=["doc_id", "row", "item_id", "cosine", "lcs", "answer", "word"],
            )

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    rank: int = RANK, cosine: float = COSINE, share: float = SHARE, answer: float = ANSWER,
) -> DataFrame:
    """(doc_id, row, item_id, cosine, lcs, answer, word) of each text and item it holds; ``row`` is a digest of id and text."""
    rows = docs.select(F.col(id).cast("long").alias("id"), _row(id, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found: DataFrame | None = None
    for turn, block in enumerate(blocks(benchmark, item_id, item_text)):
        names = [i for i, _ in block]
        vocabulary: dict[str, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]) for _, words in block]
        encoded = scratch.write(rows.mapInArrow(lean(_encode(vocabulary)), "id long, row string, ids binary"), f"encoded{turn}")
        counts = sum_arrays(encoded.select("ids"), _frequencies(len(vocabulary)), len(vocabulary) + 1)
        passages = counts[-1]
        parts = [part for words in items for part in _even(words, 2 * STEP)]
        idf, often = weights(counts[:-1], passages, parts), frequent(counts[:-1], passages)
        matrix = np.zeros((len(parts), len(vocabulary)), np.float32)
        for at, words in enumerate(parts):
            np.add.at(matrix[at], words, idf[words])
        basis = latent_space(encoded, idf, matrix, rank, often)
        hits = encoded.mapInArrow(lean(_search(names, items, idf, basis, often, cosine, share, answer)), _PAIR)
        hits = scratch.write(hits, f"hits{turn}")
        scratch.drop(f"encoded{turn}")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], _PAIR)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, all columns as they were."""
    row = fresh(docs, "wl_row")
    hit = leaks(docs, benchmark, scratch, id, text, **settings).select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, _row(id, text)).join(hit, row, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "leaks"))
    return found.drop("row")
