"""Documents as they arrive: findings in append mode, and only those a baseline lacks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlight.operators import baseline as bl
from wardlight.operators import line_rules as lr
from wardlight.session import cut, shared_folder
from wardlight.sources.corpus import explode_lines


def read_documents(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Document files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def read_table(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """One table as a stream, be it a single file or a folder of part files.

    A stream takes a folder, or a pattern that names files or folders; the last character
    as a set of one makes the path such a pattern.
    """
    path = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def stream_findings(docs: DataFrame) -> DataFrame:
    """Line findings of a document stream. The rules know no state, so append mode needs none."""
    return lr.line_findings(explode_lines(docs))


def write_findings(findings: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append findings to a parquet table, each exactly once."""
    writer = findings.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


USED = "rule_id string, file string, line int, evidence string, severity string, used long, whole boolean"


def _used(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """What batches before ``number`` used of each baseline key; a whole row stands for all batches up to its own."""
    rows = spark.read.schema(f"{USED}, batch long").option("basePath", folder).parquet(folder).where(F.col("batch") < number)
    base = rows.where("whole").agg(F.max("batch")).first()[0]
    return rows.where(F.lit(base is None) | (F.col("batch") > F.lit(base)) | ((F.col("batch") == F.lit(base)) & F.col("whole")))


def write_new_findings(findings: DataFrame, baseline: DataFrame, out: str, checkpoint: str, available_now: bool = False, fold_every: int = 50) -> StreamingQuery:
    """Keep what the baseline does not list, counting repeats; a file may come in any number of batches.

    The state of the stream is what earlier batches have used of each baseline key, a table beside the
    output with one folder a batch. A batch meets what is left of the keys of its files, in the order of
    arrival, and writes what it used; a batch that is run again reads only the batches before it and
    replaces its own folders, so a restart changes nothing. Every ``fold_every`` batches one folder takes
    the sums over all, so a batch reads few folders. The baseline is counted and written once.
    """
    spark, state = findings.sparkSession, f"{out.rstrip('/')}/_used"
    counts = cut(bl.count_keys(baseline))
    spark.createDataFrame([], USED).write.mode("overwrite").parquet(f"{state}/batch=-1")

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read several times; lost blocks are computed again
        files = batch.select(F.col("file").alias("_file")).distinct()
        earlier = _used(spark, state, number)
        of_files = F.col("file").eqNullSafe(F.col("_file"))
        spent = earlier.join(files, of_files, "left_semi").groupBy(*bl.KEY).agg(F.sum("used").alias("used"))
        mine = counts.join(files, of_files, "left_semi").alias("l").join(spent.alias("r"), bl._same(bl.KEY), "left")
        left = mine.select(*[F.col(f"l.{k}") for k in bl.KEY], (F.col("l.n_baseline") - F.coalesce("r.used", F.lit(0))).alias("n_baseline"))
        judged = cut(bl.annotate(batch, left, ["line", "rule_order"], F.floor(F.coalesce("line", F.lit(0)) / 256)))
        now = judged.where("baseline_state = 'matched'").groupBy(*bl.KEY).agg(F.count("*").alias("used"))
        whole = number % fold_every == fold_every - 1
        if whole:
            now = earlier.select(*bl.KEY, "used").unionByName(now).groupBy(*bl.KEY).agg(F.sum("used").alias("used"))
        now.withColumn("whole", F.lit(whole)).write.mode("overwrite").parquet(f"{state}/batch={number}")
        judged.where("baseline_state = 'new'").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    writer = findings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def fresh_folders(spark: SparkSession) -> tuple[str, str]:
    """Output and checkpoint folders of a run, in the folder all executors share."""
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"
