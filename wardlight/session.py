"""Session settings, checkpoint folder and small helpers shared by all stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a job over large tables wants. None of these depends on the data; the
# number of shuffle partitions is left to AQE, which coalesces a generous start.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", app: str = "wardlight", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **RECOMMENDED,
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A cluster has to name it. A local session that does not, as in tests, uses a folder
    in its warehouse.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current:
        return named or current
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/wardlight-checkpoints"
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage.

    Used between the levels of an iterative join: the plan stays small and the
    level survives the loss of an executor.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the corpus, so that the driver never collects a side for a broadcast.

    The planner takes exploded rows for no larger than the rows they come from, and so
    broadcasts tables of hundreds of megabytes.
    """
    return df.hint("merge")


def settle(spark: SparkSession) -> None:
    """Collect the driver's garbage, mostly plans of finished stages; Spark's cleaner then drops their shuffle and checkpoint files."""
    spark.sparkContext._jvm.System.gc()


def sql_literal(value) -> str:
    """One Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        inner = ", ".join(sql_literal(v) for v in value)
        return f"array({inner})" if value else "cast(array() as array<string>)"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return "'" + text.replace("\n", "\\n").replace("\t", "\\t") + "'"


def constant_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A table of constants known when the program is written.

    It becomes a LocalRelation, so its exact size is known to the planner and
    joins against it are broadcast without a hint.
    """
    body = ",\n".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def set_of(values: Sequence[str]) -> Column:
    """A constant array column."""
    return F.array(*[F.lit(v) for v in values])
