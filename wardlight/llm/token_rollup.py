"""Token counts as delta-maintained rollups.

A batch of changes carries texts to insert or revise and ids to delete, counted under one or more
tokenizer versions. The commit turns it into signed deltas: what the touched ids counted before
leaves, what they count now enters. Deltas are additive by (source, lang, version), so totals are one
sum over the committed batches, and nothing that a batch does not touch is read but the state of its
ids. The state holds, for each batch, what the (id, version)s it touched count from then on; the latest
batch of an (id, version) holds. An upsert replaces the id under the batch's versions, a delete under all.

Commits are idempotent and ordered: a batch is written below its number and counts once its marker,
written last, exists. A repeated commit finds the marker and does nothing; a failed one is overwritten; a
late batch, whose number is below one that is committed already, is refused, for it would undo what is newer.
``compact`` folds committed batches into one and keeps all their numbers, so a repeat is known afterwards too.

Tokenizers are files; their bytes travel with the tasks, so executors need no copy. Defined
results: null texts count 0 tokens and one document; null ids are one id, null sources and
languages groups of their own. Rows of one id in one batch count together. Deleting an unknown id
changes nothing. An empty batch commits and changes nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import Scratch, table

TOKENIZERS = "/opt/tokenizers"
#: How the published vocabularies split text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STATE = "doc_id long, source string, lang string, version string, docs long, tokens long"
DELTA = "source string, lang string, version string, docs long, tokens long"
_STATE, _KEY = [f.split()[0] for f in STATE.split(", ")], ["source", "lang", "version"]
_ENCODERS: dict[str, object] = {}


@dataclass(frozen=True)
class Tokenizer:
    version: str
    ranks: bytes  # a file of base64 token and rank
    pieces: str = PIECES

    @classmethod
    def named(cls, version: str, folder: str = TOKENIZERS) -> "Tokenizer":
        with open(f"{folder}/{version}.tiktoken", "rb") as file:
            return cls(version, file.read())

    def encoder(self):
        """Built once in a worker, which keeps one at a time."""
        if self.version not in _ENCODERS:
            import tiktoken

            _ENCODERS.clear()
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            _ENCODERS[self.version] = tiktoken.Encoding(self.version, pat_str=self.pieces, mergeable_ranks=ranks, special_tokens={})
        return _ENCODERS[self.version]


def token_count(tokenizer: Tokenizer) -> Callable:
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = tokenizer.encoder()
        for batch in batches:
            yield pd.Series([len(encoder.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return count


class Rollup:
    """The rollup below ``folder``: state, deltas and markers by batch number."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def committed(self) -> list[int]:
        system, place = self._exists(f"{self.folder}/committed")
        if not system.exists(place):
            return []
        names = [s.getPath().getName() for s in system.listStatus(place)]
        found = {int(n): n for n in names if n.isdigit()}
        return sorted(n for n in found if system.exists(self._exists(f"{self.folder}/committed/{n}/_SUCCESS")[1]))

    def _read(self, kind: str, schema: str) -> DataFrame:
        """Rows of the committed batches with their batch number; batches that were folded into a later one have none."""
        system, _ = self._exists(self.folder)
        paths = [path for n in self.committed() if system.exists(self._exists(path := f"{self.folder}/{kind}/batch={n}")[1])]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def state(self) -> DataFrame:
        """What each live id counts now, by version."""
        rows = self._read("state", STATE)
        last = rows.groupBy("doc_id", F.col("version").alias("v")).agg(F.max("batch").alias("batch"))
        same = rows["doc_id"].eqNullSafe(last["doc_id"]) & (rows["version"] == last["v"]) & (rows["batch"] == last["batch"])
        return rows.join(last, same, "left_semi").filter("docs > 0").drop("batch")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens; groups that count nothing any more are left out."""
        rows = self._read("deltas", DELTA).groupBy(*_KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return rows.filter((F.col("docs") != 0) | (F.col("tokens") != 0))

    def commit(self, batch: int, upserts: DataFrame | None, deletes: DataFrame | None, *tokenizers: Tokenizer) -> bool:
        """Apply (doc_id, source, lang, text), counted under each tokenizer, and the ids to delete; False when ``batch`` is committed already.

        An id that a batch both deletes and upserts is upserted: it leaves the versions that the batch does not count.
        """
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} is late: {done[-1]} is committed")
        place = f"{self.folder}/pending/batch={batch}"
        parts = []
        for i, tokenizer in enumerate(tokenizers if upserts is not None else ()):  # a job each: a worker holds one vocabulary
            counted = upserts.select("doc_id", "source", "lang", F.lit(tokenizer.version).alias("version"), token_count(tokenizer)("text").alias("tokens"))
            counted = counted.groupBy("doc_id", *_KEY).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
            parts.append(f"{place}/part_{i}")
            counted.select(*_STATE).write.mode("overwrite").parquet(parts[-1])
        new = self.spark.read.schema(STATE).parquet(*parts) if parts else self.spark.createDataFrame([], STATE)
        # a null version stands for all versions of a deleted id
        touched = new.select(F.col("doc_id").alias("touched"), F.col("version").alias("v"))
        if deletes is not None:
            touched = touched.unionByName(deletes.select(F.col("doc_id").alias("touched"), F.lit(None).cast("string").alias("v")))
        touched = touched.distinct().groupBy("touched").agg(F.collect_set("v").alias("versions"), F.bool_or(F.col("v").isNull()).alias("whole"))
        now = self.state()
        old = now.join(touched, now["doc_id"].eqNullSafe(touched["touched"])).filter(F.col("whole") | F.array_contains("versions", F.col("version"))).select(*_STATE)
        zero = F.lit(0).cast("long")
        again = new.select(F.col("doc_id").alias("again"), F.col("version").alias("v")).distinct()
        gone = old.join(again, F.col("doc_id").eqNullSafe(F.col("again")) & (F.col("version") == F.col("v")), "left_anti")
        state = new.unionByName(gone.select("doc_id", *_KEY, zero.alias("docs"), zero.alias("tokens")).dropDuplicates(["doc_id", "version"]))
        signed = new.select(*_KEY, "docs", "tokens").unionByName(old.select(*_KEY, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        deltas = signed.groupBy(*_KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        state.select(*_STATE).write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")
        deltas.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        self._mark(batch)
        return True

    def _mark(self, batch: int) -> None:
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/committed/{batch}")

    def compact(self, other: str) -> "Rollup":
        """A rollup below ``other`` with the same state, totals and committed numbers, all rows in the latest batch."""
        batches = self.committed()
        new = Rollup(self.spark, other)
        if batches:
            self.state().write.mode("overwrite").parquet(f"{new.folder}/state/batch={batches[-1]}")
            self.totals().write.mode("overwrite").parquet(f"{new.folder}/deltas/batch={batches[-1]}")
            for batch in reversed(batches):  # the latest first: without the rows no earlier number counts
                new._mark(batch)
        return new


FIRST, SECOND = "byte_bpe_50k", "byte_bpe_multi_50k"


def history(spark, docs: DataFrame, labels: DataFrame, folder: str, tokenizers: str = TOKENIZERS) -> Rollup:
    """All documents inserted under both tokenizers; those whose text is not all ASCII revised, white space folded;
    those labelled as of low quality deleted; the revision committed once more."""
    rollup = Rollup(spark, folder)
    both = [Tokenizer.named(version, tokenizers) for version in (FIRST, SECOND)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    revised = rows.filter(F.octet_length("text") > F.char_length("text")).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    bad = labels.filter("quality = 0").select(F.col("doc_id").cast("long").alias("doc_id"))
    for batch, upserts, deletes in ((1, rows, None), (2, revised, None), (3, None, bad), (2, revised, None)):
        rollup.commit(batch, upserts, deletes, *both)
    return rollup


def query(spark, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "rollup").path("rollup")
    return history(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folder).totals()
