"""Near duplicates by Order MinHash over word shingles, verified by banded alignment.

A text's items are its shingles of ``k`` lower-cased words, each labelled with its occurrence,
so a repeated shingle is several items. Each of ``sketches`` hash functions samples the ``sample``
smallest items and keeps them in text order: two texts collide when they share these items *and*
their order. A pair is a link when the longest chain of items common to both, in the same order
and within the diagonal band that the threshold allows, covers ``threshold`` of the items of
either: chain / (n + m - chain). For texts without moved parts that is shingle Jaccard.

With 3 items in 16 sketches a pair at 0.8 is missed with probability (1 - 0.8^3)^16 = 1e-5.

Work per bucket is stars, not all pairs: every member meets the centre, the node that shares most
buckets with others. What these stars link is one component; in buckets of several, whoever is left meets the
next centres of other components (``set_join.centred``). Members left in buckets that still hold several components may have links that no star
sees. Each is described by how its set of items differs from the first centre's: two sets at the
threshold that lie in different components share one of the first labels of their differences, by
prefix filtering as in ``set_join``, labels that many members have last; sets near the centre that are not in its component (parts were moved)
meet all that are near it. Pairs are ruled out by histograms of their items before whole texts are moved. No
link between different texts that share a bucket is lost. Copies (equal word sequences) are one node from
the start. Components come from label propagation with pointer jumping over written tables.

Defined results: null and empty texts have no items; texts without words are copies of each
other. A text of fewer than ``k`` words is one item. The class is named by its smallest id
(null ids are ignored unless the class has no other); the row that stays is the one with the
smallest (id, row digest). Rows equal in id and text are one document: ``kept`` is equal on
them, ``keep_one`` keeps one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm import set_join as sj
from wardlight.llm.common import Scratch, connected, fresh, lean, merged, table  # noqa: F401

K, SAMPLE, SKETCHES, THRESHOLD = 5, 3, 16, 0.8
_WORD = re.compile(r"\w+")
_STEP, _GOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_CACHE = 150_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Items:
    """Occurrence-labelled shingles as 64-bit labels; words are hashed once while they are cached."""

    def __init__(self, k: int):
        self.k, self.hashes = k, {}

    def labels(self, words: list[str]) -> np.ndarray:
        if len(self.hashes) > _CACHE:
            self.hashes.clear()
        seen, out = self.hashes, []
        for word in words:
            value = seen.get(word)
            if value is None:
                value = seen[word] = xxhash.xxh64_intdigest(word)
            out.append(value)
        if not out:
            return np.zeros(0, np.uint64)
        one = np.array(out, np.uint64)
        width = min(self.k, len(one))
        count = len(one) - width + 1
        item = np.full(count, width, np.uint64)
        for j in range(width):
            item = (item ^ one[j : j + count]) * _STEP
            item ^= item >> np.uint64(29)
        order = np.argsort(item, kind="stable")
        ranked = item[order]
        again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
        if len(again):
            first = np.arange(count)
            starts = np.maximum.accumulate(np.where(np.concatenate([[True], ranked[1:] != ranked[:-1]]), first, 0))
            item[order] = ranked + (first - starts).astype(np.uint64) * _GOLD
        return item


def sketch(labels: np.ndarray, sample: int, sketches: int) -> list[int]:
    """Signed 64-bit sketch values; a text of at most ``sample`` items has one, of all of them."""
    if not len(labels):
        return []
    if len(labels) <= sample:
        return [_signed(labels, len(labels))]
    seeds = np.arange(1, sketches + 1, dtype=np.uint64) * _GOLD
    mixed = (labels[None, :] ^ seeds[:, None]) * _STEP
    mixed ^= mixed >> np.uint64(31)
    mixed *= _GOLD
    mixed ^= mixed >> np.uint64(28)
    lowest = np.sort(np.argpartition(mixed, sample - 1, axis=1)[:, :sample], axis=1)
    return [_signed(labels[row], turn + 1000) for turn, row in enumerate(lowest)]


def _signed(labels: np.ndarray, seed: int) -> int:
    value = xxhash.xxh64_intdigest(labels.tobytes(), seed)
    return value - (1 << 64) if value >= 1 << 63 else value


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Share of the items of ``a`` and ``b`` on the longest common chain inside the band; 0 below the threshold."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at) < threshold * (n + m - len(at)):
        return 0.0
    band = int((1 - threshold) / (1 + threshold) * (n + m)) + 1
    near = np.abs(at - to) <= band
    to = to[near][np.argsort(at[near])]
    if len(to) > 1 and not (np.diff(to) > 0).all():
        tails: list[int] = []
        for place in to.tolist():
            spot = bisect_left(tails, place)
            tails[spot : spot + 1] = [place]
        chain = len(tails)
    else:
        chain = len(to)
    share = chain / (n + m - chain)
    return share if share >= threshold else 0.0


def _features(k: int, sample: int, sketches: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(k)
        for batch in batches:
            nodes, counts, bins, values = [], [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                labels = items.labels(words)
                nodes.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).hexdigest())
                counts.append(len(labels))
                bins.append(sj.histogram(labels).tobytes())
                values.append(sketch(labels, sample, sketches))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.string()), pa.array(counts, pa.int64()), pa.array(bins, pa.binary()), pa.array(values, pa.list_(pa.int64()))],
                names=["id", "row", "node", "n", "bins", "sketches"],
            )

    return run


def _ordered(k: int) -> Callable:
    """(node, text) -> node, labels in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(k)
        for batch in batches:
            labels = [items.labels(words_of(text.as_py())).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.binary())], names=["node", "items"])

    return run


def _labels(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _verified(threshold: float) -> Callable:
    """(a, b, items_a, items_b) -> links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = np.array([aligned(_labels(batch.column(2)[i]), _labels(batch.column(3)[i]), threshold) for i in range(batch.num_rows)], np.float64)
            columns = [pa.array(batch.column(at).to_numpy()[shares > 0]) for at in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shares[shares > 0])], names=["a", "b", "similarity"])

    return run


def _row(id: str, text: str) -> Column:
    """A key of rows equal in id and text."""
    return F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("null")), F.lit("\x1f"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def classes(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", k: int = K, sample: int = SAMPLE, sketches: int = SKETCHES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, row, class_id, class_row, class_size, kept."""
    rows = docs.select(F.col(id).cast("long").alias("id"), _row(id, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    features = rows.mapInArrow(lean(_features(k, sample, sketches)), "id long, row string, node string, n long, bins binary, sketches array<long>")
    features = scratch.write(features.withColumn("num", F.monotonically_increasing_id()), "features")
    first = features.groupBy("node").agg(F.min(F.struct("num", "row", "n", "bins", "sketches")).alias("one"))
    nodes = scratch.write(first.select("node", F.col("one.num").alias("num"), "one.row", "one.n", "one.bins", "one.sketches"), "nodes")
    entries = nodes.select(F.explode("sketches").alias("entry"), F.col("num").alias("node"), "n")
    sizes = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    known = scratch.write(entries.join(sizes, "entry"), "known")
    bins = nodes.select(F.col("num").alias("node"), "n", "bins")
    found = linked(
        known, bins, lambda wanted: rows.join(nodes.join(wanted, nodes["num"] == wanted["node"], "left_semi").select("row", F.col("num").alias("node")), "row").dropDuplicates(["node"]).select("node", "text"),
        scratch, k, threshold,
    )
    owners = features.select("id", "row", "node", "num").join(nodes.select("node", F.col("num").alias("rep")), "node", "left").select("id", "row", F.coalesce("rep", "num").alias("rep"))
    placed = scratch.write(owners.join(found.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("id", "row", F.coalesce("comp", "rep").alias("comp")), "placed")
    for done in ("features", "nodes", "known"):  # the result reads ``placed`` alone
        scratch.drop(done)
    named = placed.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("blank"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    named = named.filter("class_size > 1").select("comp", F.col("first.id").alias("class_id"), F.col("first.row").alias("class_row"), "class_size")
    alone = F.col("class_size").isNull()
    return placed.join(named, "comp", "left").select(
        "id", "row", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("row")).otherwise(F.col("class_row")).alias("class_row"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (alone | (F.col("row") == F.col("class_row"))).alias("kept"),
    )


def linked(known: DataFrame, bins: DataFrame, texts_of: Callable[[DataFrame], DataFrame], scratch: Scratch, k: int, threshold: float) -> DataFrame:
    """(node, comp) of all links between nodes that share an entry.

    ``known``: entry, node, n (items), c (nodes of the entry). ``bins``: node, n, histogram. ``texts_of`` gives (node, text) of wanted nodes.
    """
    share = int(threshold * 100)  # candidates by sets at the threshold or a little below

    def sets_of(nodes: DataFrame) -> DataFrame:
        return texts_of(nodes).mapInArrow(lean(_ordered(k)), "node long, items binary")

    def verify(pairs: DataFrame, items: DataFrame, name: str) -> DataFrame:
        both = pairs.join(items.toDF("b", "items_b"), "b").join(items.toDF("a", "items_a"), "a").select("a", "b", "items_a", "items_b")
        return scratch.write(both.mapInArrow(lean(_verified(threshold)), "a long, b long, similarity double"), name)

    left, star, parts, items = sj.centred(known, bins, share, scratch, sets_of, verify)
    rest = scratch.write(sj.across(left, parts, items, share, scratch, moved=True, ranked=True).join(star, ["a", "b"], "left_anti"), "rest")
    more = verify(sj.may_link(rest, bins, share, scratch, "near-rest"), items, "links-rest")
    found = merged(parts, more, scratch, "all") if more.limit(1).count() else parts
    for done in ("items-0", "items-1", "star-0", "star-1", "near-0", "near-1", "rest", "differences", "described"):
        scratch.drop(done)
    return found


def keep_one(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each class, all columns as they were."""
    columns, row, kept = docs.columns, fresh(docs, "wl_row"), fresh(docs, "wl_kept")
    marks = classes(docs, scratch, id, text, **settings).filter("class_size > 1").groupBy("row").agg(F.max("kept").alias("kept"))
    marked = docs.withColumn(row, _row(id, text)).join(scratch.write(marks.toDF(row, kept), "marks"), row, "left")
    alone = marked.filter(F.col(kept).isNull()).select(*columns)
    return alone.unionByName(marked.filter(F.col(kept)).dropDuplicates([row]).select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), Scratch(spark, "near"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
