"""Scanning a corpus again: only files that changed are read.

What texts yield (findings of single files, steps) is kept as tables, with an index of the files they come
from: target, path and digest of the content. A refresh compares the index with the documents as they are:
files with the same digest keep their rows, files that are new or changed are read, files that are gone lose their
rows. Chains, graph, paths and verdicts are computed from those tables as in a full scan, so they are the same.

Every refresh writes a generation of its own below the folder and its marker last; a refresh that died
is overwritten by the next one, and the generation before the last stays readable until then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import targets as tg
from wardlight.plans import scan
from wardlight.session import by_merge, cut, settle

KINDS = ("files", "raw", "steps")


def file_digests(docs: DataFrame, keys: Sequence[str], digest: str | None = None) -> DataFrame:
    """(keys, path, digest) of files. Rows of one path are one file, so its digest is that of all their texts, repeats included.

    ``digest`` names a column that tells versions apart (a checksum of the store, a modification time); without
    it the texts are hashed, and that is all that is read of files that have not changed.
    """
    own = F.sha2(F.coalesce("text", F.lit("\u0000")), 256) if digest is None else F.col(digest).cast("string")
    rows = docs.select(*keys, "path", F.coalesce(own, F.lit("")).alias("own"))
    return rows.groupBy(*keys, "path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("own")), ","), 256).alias("digest"))


class Results:
    """The kept tables of one corpus below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, scan_keys: Sequence[str]):
        self.spark, self.folder, self.names = spark, folder.rstrip("/"), list(scan_keys)
        spark.createDataFrame([(-1,)], "generation int").coalesce(1).write.mode("ignore").parquet(f"{self.folder}/marks/generation_0")

    def generation(self) -> int:
        """The last complete one, -1 when there is none."""
        return self.spark.read.schema("generation int").parquet(f"{self.folder}/marks/*").agg(F.max("generation")).first()[0]

    def _table(self, kind: str, generation: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}/{generation}")

    def refresh(self, docs: DataFrame, digest: str | None = None) -> scan.Found:
        """Bring the tables up to ``docs`` (scan keys, path, text) and return what a full scan of them finds."""
        names = self.names
        docs = tg.seal(docs, names)
        keys = [tg.BOX] if names else []
        file = [*keys, "path"]
        last = self.generation()
        new = last + 1
        files = file_digests(docs, keys, digest)
        files.write.mode("overwrite").parquet(f"{self.folder}/files/{new}")
        files = self._table("files", new)
        if last < 0:
            raw, steps = scan.extract(docs, keys)
        else:
            same = cut(self._joined(files, self._table("files", last), [*file, "digest"], "left_semi").select(*file))
            changed = cut(self._joined(files, same, file, "left_anti").select(*file))
            raw, steps = scan.extract(self._joined(docs, changed, file, "left_semi"), keys)
            raw = raw.unionByName(self._joined(self._table("raw", last), same, file, "left_semi"))
            steps = steps.unionByName(self._joined(self._table("steps", last), same, file, "left_semi"))
        raw.write.mode("overwrite").parquet(f"{self.folder}/raw/{new}")
        steps.write.mode("overwrite").parquet(f"{self.folder}/steps/{new}")
        self.spark.createDataFrame([(new,)], "generation int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/generation_{new + 1}")
        raw = steps = same = changed = None
        settle(self.spark)
        found = scan.correlate(self._table("raw", new), self._table("steps", new), keys)
        return scan.Found(*[tg.unseal(table, names) for table in (found.findings, found.contributors, found.steps)])

    @staticmethod
    def _joined(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
        named = by_merge(right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)]))
        cond = F.lit(True)
        for i, c in enumerate(columns):
            cond = cond & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        return left.join(named, cond, how)
