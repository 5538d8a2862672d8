"""Ranked lexical search by NRA: sorted reads, score intervals, no random look-ups.

A posting's impact is the term's weight times the saturated frequency of the term in the document,
all in integers; a document's score for an item is the sum over the item's terms. The corpus is
encoded once against the terms of the items (a written table: document, length, terms, counts), a
second pass over that table sums document frequencies and lengths, and the search runs where the
encoded rows lie. Rows are gathered into segments of at most ``segment`` postings whose lists are
sorted by impact. For each item the lists are read from the top, ``first`` postings each, then
twice as many, and so on. A document's lower bound is the sum of what was read of it; its upper bound
adds, for each list in which it has not been seen, the impact last read there (0 at the end of a list).
Documents whose upper bound is below the k-th lower bound, or below the k-th score a task has already
found in earlier segments, are given up. Reading goes on until the intervals of all documents left
have closed; a list in which all of them have been seen is read no further. So members, ties and
scores are exact. Each task hands over its ``k`` best rows per item, which are ranked by item in two
rounds, first in salted groups.

Items are worked on in blocks of about ``block_terms`` distinct terms (counted per item); a block's
terms are known to all tasks, so this bounds what is sent to them, and every block sees all documents.

Defined results: terms are runs of ASCII letters and digits and of any other non-ASCII characters; only A-Z
are lower-cased. Null and empty texts have no term and do not count in N. Each row is a document, so repeated
rows get ranks of their own, ids being equal; null ids come last among equal scores. Rows of one item_id are
one item with the terms of all; items without terms (null, empty) have no row, nor have documents that
score 0. Very long texts are counted whole. Empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import Scratch, sum_arrays, table

K, SEGMENT, FIRST, BLOCK_TERMS, SALTS = 10, 1 << 20, 64, 1_000_000, 64
FULL, KEPT = 90, 10  # per cent of the length that counts in full, and of the mean that always does
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max  # stands for a null id


def terms_of(text: bytes | str | None) -> list[bytes]:
    """Terms of a text as UTF-8 bytes."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_KEEP).split(b" ")


def counted(text: bytes | str | None) -> tuple[int, Counter]:
    found = Counter(terms_of(text))
    found.pop(b"", None)
    return found.total(), found


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [list(counted(text.as_py())[1]) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.binary()))], names=["item", "terms"])


def _encoded(places: dict[bytes, int]) -> Callable:
    """(id, text) -> id, length, places of the known terms, their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                n, found = counted(text.as_py())
                known = [(places[word], tf) for word, tf in found.items() if word in places]
                lengths.append(n)
                terms.append([one for one, _ in known])
                counts.append([tf for _, tf in known])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "n", "terms", "counts"]
            )

    return run


def statistics(encoded: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Document frequencies of the ``size`` terms, documents with a term, terms in all."""

    def fill(batches, total):
        for batch in batches:
            n, terms = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
            total[:size] += np.bincount(terms, minlength=size)
            total[size] += np.count_nonzero(n)
            total[size + 1] += n.sum()

    found = sum_arrays(encoded.select("n", "terms"), fill, size + 2)
    return found[:size].astype(np.int64), int(found[size]), int(found[size + 1])


def weights(frequency: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * frequency + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = KEPT + (FULL * n * documents) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int, first: int = FIRST) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the ``k`` best with a score of at least ``floor``, their exact scores, postings read.

    A list holds document numbers below ``size`` and their impacts, largest first. All documents whose
    score ties with the k-th are returned, so the caller can order ties by anything.
    """
    lower = np.zeros(size, np.int64)
    alive = np.ones(size, bool)
    ceiling = np.array([values[0] if len(values) else 0 for _, values in lists], np.int64)
    at, going = [0] * len(lists), [i for i, (docs, _) in enumerate(lists) if len(docs)]
    seen_docs, seen_lists = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step, read = first, 0
    while True:
        docs_now, lists_now = [seen_docs], [seen_lists]
        for i in going:
            docs, values = lists[i]
            part, gain = docs[at[i] : at[i] + step], values[at[i] : at[i] + step]
            at[i] += len(part)
            read += len(part)
            ceiling[i] = gain[-1] if at[i] < len(docs) else 0
            use = alive[part]
            part = part[use]
            lower[part] += gain[use]
            docs_now.append(part)
            lists_now.append(np.full(len(part), i))
        seen_docs, seen_lists = np.concatenate(docs_now), np.concatenate(lists_now)
        least = max(floor, 1)
        if size > k:
            least = max(least, int(np.partition(lower, size - k)[size - k]))
        missing = int(ceiling.sum()) - np.bincount(seen_docs, ceiling[seen_lists], size).astype(np.int64)
        alive &= lower + missing >= least
        left = np.count_nonzero(alive)
        if not left or not missing[alive].any():
            return np.flatnonzero(alive), lower[alive], read
        use = alive[seen_docs]
        seen_docs, seen_lists = seen_docs[use], seen_lists[use]
        met = np.bincount(seen_lists, minlength=len(lists))
        going = [i for i in going if at[i] < len(lists[i][0]) and met[i] < left]
        step *= 2


def _searched(items: list[tuple], weight: np.ndarray, documents: int, length: int, k: int, segment: int) -> Callable:
    """(id, n, terms, counts) -> the ``k`` best of the task for each item: number of the item, id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        held, postings = [], 0

        def search() -> None:
            ids = np.concatenate([part[0] for part in held])
            owner = np.concatenate([part[1] + shift for part, shift in zip(held, np.cumsum([0] + [len(part[0]) for part in held]))])
            terms, values = np.concatenate([part[2] for part in held]), np.concatenate([part[3] for part in held])
            order = np.lexsort((-values, terms))
            terms, owner, values = terms[order], owner[order], values[order]
            starts = np.searchsorted(terms, np.arange(len(weight) + 1))
            for number, (_, places) in enumerate(items):
                own_ids, own_scores = best[number]
                floor = int(own_scores[k - 1]) if len(own_scores) >= k else 0
                lists = [(owner[starts[p] : starts[p + 1]], values[starts[p] : starts[p + 1]]) for p in places if starts[p] < starts[p + 1]]
                if not lists:
                    continue
                found, scores, _ = nra(lists, len(ids), k, floor)
                if len(found):
                    all_ids, all_scores = np.concatenate([own_ids, ids[found]]), np.concatenate([own_scores, scores])
                    top = np.lexsort((all_ids, -all_scores))[:k]
                    best[number] = (all_ids[top], all_scores[top])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            n, sizes = batch.column(1).to_numpy(), batch.column(2).value_lengths().to_numpy()
            terms, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            owner = np.repeat(np.arange(len(ids)), sizes)
            gain = impacts(weight[terms], tf, n[owner], documents, max(length, 1))
            held.append((ids, owner, terms, gain))
            postings += len(terms)
            if postings >= segment:
                search()
                held, postings = [], 0
        if held:
            search()
        numbers = [np.full(len(ids), i, np.int64) for i, (ids, _) in enumerate(best)]
        columns = [np.concatenate(part) if part else np.zeros(0, np.int64) for part in (numbers, [b[0] for b in best], [b[1] for b in best])]
        names = pa.array([items[i][0] for i in columns[0]], pa.int64())
        ids = pa.array(columns[1], mask=columns[1] == _LAST)
        yield pa.RecordBatch.from_arrays([names, ids, pa.array(columns[2])], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, segment: int = SEGMENT, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item, ids as long."""
    asked = items.select(F.col(item_id).cast("long").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    asked = asked.mapInArrow(_item_terms, "item long, terms array<binary>").select("item", F.explode("terms").alias("term")).distinct()
    asked = scratch.write(asked, "terms")
    blocks = -(-asked.count() // block_terms)
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()
        if not part:
            continue
        places = {word: i for i, word in enumerate(sorted({bytes(word) for row in part for word in row["terms"]}))}
        encoded = scratch.write(rows.mapInArrow(_encoded(places), "id long, n long, terms array<int>, counts array<long>"), f"encoded-{block}")
        frequency, documents, length = statistics(encoded, len(places))
        wanted = sorted(((row["item"], sorted(places[bytes(word)] for word in row["terms"])) for row in part), key=lambda one: (one[0] is None, one[0]))
        job = _searched(wanted, weights(frequency, documents), documents, length, k, segment)
        best = encoded.filter("n > 0").mapInArrow(job, "item_id long, doc_id long, score long")
        found = found.unionByName(scratch.write(best, f"found-{block}"))
        scratch.drop(f"encoded-{block}")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "search"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH doc AS (SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS terms FROM documents),
sizes AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM doc WHERE len(terms) > 0),
item AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
post AS (SELECT place, doc_id, term, CAST(len(terms) AS BIGINT) AS n, count(*) AS tf
         FROM (SELECT place, doc_id, terms, unnest(terms) AS term FROM doc) WHERE term IN (SELECT term FROM item) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, sizes GROUP BY term),
scored AS (SELECT item_id, place, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
           FROM post JOIN weight USING (term) JOIN item USING (term), sizes GROUP BY item_id, place, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER best <= 10
"""
