"""Exact duplicates by Patricia tries.

Texts are pre-aggregated where they are read, so a text that fills a third of the table
leaves each task once. The shuffle deals (byte length, head of the SHA-256) partitions; a
task reads them sorted and inserts the full byte strings into a compressed radix trie whose
terminal nodes hold the owner, the number of rows and the number of rows of the owner's id.
Sorting is the spill: a finished subtree, which is one (length, hash head) or, beyond
``trie_bytes``, one digest, is emitted and dropped, so a task never holds more than the bound
and one text. Digests only deal rows out; texts are equal when the trie says so.

Defined results: null is the empty text. A null id is smaller than any other. Rows equal in
id and text are one document listed as often as it occurs (``kept`` is equal on all of them;
``keep_one`` keeps one). An empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.llm.common import Scratch, lean, table

HEAD = 4  # hex digits of the digest that deal rows out
PIECE = "bytes int, head string, sha string, text binary, owner long, n long, same long"
OWNER = "sha string, keep_id long, group_size long, same long"


class RadixTrie:
    """Compressed radix trie over byte strings; a node is [record, {first byte: [label, child]}]."""

    def __init__(self) -> None:
        self.root: list = [None, {}]
        self.bytes = 0

    def node(self, key: bytes) -> list:
        """The terminal node of ``key``, made on first use."""
        node, at, end = self.root, 0, len(key)
        while at < end:
            edge = node[1].get(key[at])
            if edge is None:
                child: list = [None, {}]
                node[1][key[at]] = [key[at:], child]
                self.bytes += end - at
                return child
            label, child = edge
            if key.startswith(label, at):
                at, node = at + len(label), child
                continue
            low, high = 1, min(len(label), end - at)  # the first byte agrees
            while low < high:
                mid = (low + high + 1) // 2
                if key.startswith(label[:mid], at):
                    low = mid
                else:
                    high = mid - 1
            middle: list = [None, {}]
            if low < len(label):
                middle[1][label[low]] = [label[low:], child]
            edge[0], edge[1] = label[:low], middle
            at, node = at + low, middle
        return node

    def records(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] is not None:
                yield node[0]
            stack.extend(edge[1] for edge in node[1].values())


def _better(a, b, largest: bool) -> bool:
    """Whether id ``a`` owns rather than ``b``; null is the smallest id."""
    if a is None or b is None:
        return (b is None and a is not None) if largest else (a is None and b is not None)
    return a > b if largest else a < b


def _merge(record: list, owner, n: int, same: int, largest: bool) -> None:
    record[2] += n
    if owner == record[1]:
        record[3] += same
    elif _better(owner, record[1], largest):
        record[1], record[3] = owner, same


def _pieces(largest: bool, bound: int) -> Callable:
    """One row per distinct text of a piece of the input of about ``bound`` bytes."""
    schema = pa.schema([("bytes", pa.int32()), ("head", pa.string()), ("sha", pa.string()), ("text", pa.binary()), ("owner", pa.int64()), ("n", pa.int64()), ("same", pa.int64())])

    def out(found: dict) -> pa.RecordBatch:
        shas = [hashlib.sha256(t).hexdigest() for t in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(t) for t in found], pa.int32()),
                pa.array([s[:HEAD] for s in shas], pa.string()),
                pa.array(shas, pa.string()),
                pa.array(list(found), pa.binary()),
                pa.array([r[1] for r in found.values()], pa.int64()),
                pa.array([r[2] for r in found.values()], pa.int64()),
                pa.array([r[3] for r in found.values()], pa.int64()),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, text in enumerate(batch.column(1)):
                key = text.as_py()
                record = found.get(key)
                if record is None:
                    found[key] = [None, ids[at], 1, 1]
                    held += len(key) + 200
                else:
                    _merge(record, ids[at], 1, 1, largest)
                if held > bound:
                    yield out(found)
                    found, held = {}, 0
        if found:
            yield out(found)

    return run


def _owners(largest: bool, bound: int) -> Callable:
    """Owners of texts that occur more than once, from rows sorted by (bytes, head, sha)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, part, last = RadixTrie(), None, None
        done: list[tuple] = []

        def spill() -> None:
            seen: set[str] = set()
            for sha, owner, n, same in trie.records():
                if sha in seen:
                    raise RuntimeError("two texts share a SHA-256 digest")
                seen.add(sha)
                if n > 1:
                    done.append((sha, owner, n, same))

        for batch in batches:
            sizes, heads, shas, texts, owners, counts, sames = batch.columns
            for i in range(batch.num_rows):
                sha = shas[i].as_py()
                key = (sizes[i].as_py(), heads[i].as_py())
                if part != key or (trie.bytes > bound and sha != last):
                    spill()
                    trie, part = RadixTrie(), key
                last = sha
                node = trie.node(texts[i].as_py())
                if node[0] is None:
                    node[0] = [sha, owners[i].as_py(), counts[i].as_py(), sames[i].as_py()]
                else:
                    _merge(node[0], owners[i].as_py(), counts[i].as_py(), sames[i].as_py(), largest)
            yield _owner_batch(done)
            done = []
        spill()
        yield _owner_batch(done)

    return run


def _owner_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    kinds = [("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("same", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], schema=pa.schema(kinds))


def owners(
    docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest", piece_bytes: int = 16 << 20, trie_bytes: int = 32 << 20,
) -> DataFrame:
    """(sha, keep_id, group_size, same) of every text that occurs more than once."""
    value = _value(text, normalise)
    rows = docs.select(F.col(id).cast("long").alias("id"), value.cast("binary").alias("text"))
    pieces = rows.mapInArrow(lean(_pieces(keep == "largest", piece_bytes)), PIECE)
    dealt = pieces.repartition("bytes", "head").sortWithinPartitions("bytes", "head", "sha")
    return scratch.write(dealt.mapInArrow(lean(_owners(keep == "largest", trie_bytes)), OWNER), "owners")


def _value(text: str, normalise: Callable[[Column], Column] | None) -> Column:
    value = F.coalesce(F.col(text), F.lit(""))
    return normalise(value) if normalise else value


def assign(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    found = owners(docs, scratch, id, text, normalise, keep).withColumnRenamed("sha", "text_sha256")
    rows = docs.select(F.col(id).cast("long").alias("id"), F.sha2(_value(text, normalise).cast("binary"), 256).alias("text_sha256"))
    return rows.join(found, "text_sha256", "left").select(
        F.col("id").alias(id),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id")), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def _taken(rows: list[tuple]) -> pa.Table:
    """The rows (batch, place) as a table."""
    by: dict[int, tuple] = {}
    for batch, place in rows:
        by.setdefault(id(batch), (batch, []))[1].append(place)
    return pa.Table.from_batches([batch.take(pa.array(places, pa.int64())) for batch, places in by.values()])


def _better_row(new: tuple, old: tuple | None, largest: bool) -> bool:
    """(id, tie): the owning id, then the smaller tie."""
    if old is None or new[0] == old[0]:
        return old is None or new[1] < old[1]
    return _better(new[0], old[0], largest)


def _best_pieces(width: int, plain: bool, largest: bool, bound: int) -> Callable:
    """Of each text of a piece of the input the best row; columns: ``width`` own ones, key, id, tie. Adds bytes, head, sha.

    Where the key is the text as it stands (``plain``), it is not sent along.
    """

    def out(found: dict) -> Iterator[pa.RecordBatch]:
        for batch in _taken([(b, i) for _, b, i in found.values()]).to_batches():
            keys = batch.column(width).to_pylist()
            shas = [hashlib.sha256(k).hexdigest() for k in keys]
            more = [pa.array([len(k) for k in keys], pa.int32()), pa.array([s[:HEAD] for s in shas], pa.string()), pa.array(shas, pa.string())]
            sent = [*batch.columns]
            if plain:
                sent[width] = pa.nulls(len(keys), pa.binary())
            yield pa.RecordBatch.from_arrays([*sent, *more], names=[*batch.schema.names, "wl_bytes", "wl_head", "wl_sha"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, tuple] = {}
        held = 0
        for batch in batches:
            ids, ties = batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist()
            for i, key in enumerate(batch.column(width)):
                key = key.as_py()
                old = found.get(key)
                if _better_row((ids[i], ties[i]), old and old[0], largest):
                    found[key] = ((ids[i], ties[i]), batch, i)
                    held += 0 if old else len(key) + 300
            if held > bound:
                yield from out(found)
                found, held = {}, 0
        if found:
            yield from out(found)

    return run


def _best_rows(width: int, text: int | None, largest: bool, bound: int) -> Callable:
    """The best row of each text, from rows sorted by (bytes, head, sha): the terminal nodes of the tries hold them.

    The key is the column ``text`` or, where that is None, the one sent along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, part, last = RadixTrie(), None, None

        def spill() -> Iterator[pa.RecordBatch]:
            rows = [record[1:] for record in trie.records()]
            if rows:
                yield from _taken(rows).select(range(width)).to_batches()

        for batch in batches:
            ids, ties = batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist()
            sizes, heads, shas = (batch.column(width + 3 + k).to_pylist() for k in range(3))
            keys = batch.column(width if text is None else text).cast(pa.binary())
            for i in range(batch.num_rows):
                key = (sizes[i], heads[i])
                if part != key or (trie.bytes > bound and shas[i] != last):
                    yield from spill()
                    trie, part = RadixTrie(), key
                last = shas[i]
                node = trie.node(keys[i].as_py() or b"")
                if _better_row((ids[i], ties[i]), node[0] and node[0][0], largest):
                    node[0] = ((ids[i], ties[i]), batch, i)
        yield from spill()

    return run


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None, keep: str = "smallest", piece_bytes: int = 16 << 20, trie_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with one row per text, all columns as they were.

    Whole rows go through the tries, so texts are moved once and nothing is joined. Of rows
    equal in id and text the one with the smallest hash of its columns (but maps) stays.
    """
    columns, largest = docs.columns, keep == "largest"
    own = [F.col(f"`{c}`") for c in columns]
    names = [f"wl_{i}" for i in range(len(columns))]
    rows = docs.select(
        *[c.alias(n) for c, n in zip(own, names)], _value(text, normalise).cast("binary").alias("wl_key"), F.col(id).cast("long").alias("wl_id"), F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]).alias("wl_tie")
    )
    kinds = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, columns)]
    more = [T.StructField("wl_key", T.BinaryType()), T.StructField("wl_id", T.LongType()), T.StructField("wl_tie", T.LongType())]
    more += [T.StructField("wl_bytes", T.IntegerType()), T.StructField("wl_head", T.StringType()), T.StructField("wl_sha", T.StringType())]
    place = columns.index(text) if normalise is None and isinstance(docs.schema[text].dataType, T.StringType) else None
    pieces = rows.mapInArrow(lean(_best_pieces(len(columns), place is not None, largest, piece_bytes)), T.StructType([*kinds, *more]))
    dealt = pieces.repartition("wl_bytes", "wl_head").sortWithinPartitions("wl_bytes", "wl_head", "wl_sha")
    return dealt.mapInArrow(lean(_best_rows(len(columns), place, largest, trie_bytes)), T.StructType(kinds)).toDF(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), Scratch(spark, "exact"), keep="largest")


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
