"""Helpers shared by the operators: scratch tables in the shared folder and column names."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.session import shared_folder

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Parquet tables of one operator call, below the folder all executors share.

    A written table cuts the lineage and survives the loss of an executor. The tables
    back the lazy result, so they live until the caller, who knows when the result has
    been consumed, calls ``release``.
    """

    _open: list["Scratch"] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
        Scratch._open.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def settle(self) -> None:
        """Let Spark's cleaner find the shuffle files of finished stages, which it looks for when the driver collects garbage."""
        self.spark.sparkContext._jvm.System.gc()

    @classmethod
    def release(cls) -> None:
        """Delete the tables of all earlier calls; their results must have been consumed."""
        while cls._open:
            cls._open.pop().drop()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(id_column: str) -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))


def give_back() -> None:
    """Hand memory that is free again to the system: Arrow's pool and the C library keep it, and a worker lives for many tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run`` of ``mapInArrow``, whose worker gives memory back when a task is done: an executor's idle workers stay small."""

    def batches_of(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return batches_of


def sum_arrays(rows: DataFrame, fill, size: int, fan: int = 8):
    """Sum of the arrays that ``fill`` makes of the Arrow batches of ``rows``, as a numpy array.

    ``fill(batches, total)`` adds to ``total``, an array of ``size`` float64. The rows are dealt to
    three tasks per core, so the number of arrays follows the cluster, not the data. Two rounds
    add them up: ``fan`` tasks, then one task over ``fan`` arrays. One array reaches the driver.
    """
    import numpy as np
    import pyarrow as pa

    def first(batches):
        total = np.zeros(size)
        fill(batches, total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for one in batch.column(0):
                total += np.frombuffer(one.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    slots = 3 * rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.coalesce(slots).mapInArrow(lean(first), "part binary")
    found = parts.repartition(fan).mapInArrow(lean(add), "part binary").repartition(1).mapInArrow(lean(add), "part binary").collect()
    return sum((np.frombuffer(bytes(row["part"]), np.float64) for row in found), np.zeros(size))


def most_frequent(rows: DataFrame, n: str, bound: int) -> DataFrame:
    """Rows with the largest ``n``, at most ``bound`` of them: those from the smallest level on that keeps the bound.

    Levels are sixteenths of a power of two, so finding it moves a few hundred counts, however many rows there are.
    """
    level = F.floor(F.log2(F.col(n)) * 16)
    sizes = sorted(((r[0], r[1]) for r in rows.filter(F.col(n) > 0).groupBy(level).count().collect()), reverse=True)
    least, total = None, 0
    for at, size in sizes:
        total += size
        if total > bound:
            break
        least = at
    return rows.filter(F.lit(False) if least is None else (F.col(n) > 0) & (level >= least))


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) of undirected (a, b) edges; a component is named by its smallest node.

    A turn points every node at its smallest neighbour if that is smaller, follows pointers to their ends, which are at most
    half of the nodes, and goes on with the edges between ends. An edge is read until both its ends have met, not to the last turn.
    """
    links, levels = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), f"{name}-edges-0"), []
    while links.limit(1).count() or not levels:
        at = len(levels)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points, turn, moved = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("comp")), f"{name}-{at}-0"), 0, 1
        while moved:
            turn += 1
            far = points.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
            new = scratch.write(points.join(far, "comp").select("node", F.col("far").alias("comp"), F.expr("far != comp").alias("moved")), f"{name}-{at}-{turn}")
            moved = new.filter("moved").limit(1).count()
            points = new.select("node", "comp")
            scratch.drop(f"{name}-{at}-{turn - 1}")
        levels.append(points)
        ends = links.join(points.toDF("b", "comp_b"), "b").join(points.toDF("a", "comp_a"), "a").filter("comp_a != comp_b")
        links = scratch.write(ends.select(F.least("comp_a", "comp_b").alias("a"), F.greatest("comp_a", "comp_b").alias("b")).distinct(), f"{name}-edges-{at + 1}")
        scratch.drop(f"{name}-edges-{at}")
    found = levels.pop()
    while levels:
        found = levels.pop().join(found.toDF("comp", "end"), "comp", "left").select("node", F.coalesce("end", "comp").alias("comp"))
    return scratch.write(found, f"{name}-found")


def merged(parts: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) of ``parts`` after (a, b) edges more."""
    for end in ("a", "b"):
        edges = edges.select("a", "b").join(parts.toDF(end, "comp"), end, "left").withColumn(end, F.coalesce("comp", end))
    more = connected(edges, scratch, name)
    old = parts.join(more.toDF("comp", "end"), "comp", "left").select("node", F.coalesce("end", "comp").alias("comp"))
    return scratch.write(old.unionByName(more.join(parts, "node", "left_anti").select("node", "comp")), f"{name}-merged")
