"""Baselines as files: versioned JSON documents, and tables of records for any size.

Bounds are the caller's: a document is read and written whole unless a bound is named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.operators.baseline import KEY, sorted_records
from wardlight.operators.scoring import ranked
from wardlight.session import constant_table


class SnapshotError(ValueError):
    """A snapshot cannot be used; it is never read as empty."""


def parse_snapshot(texts: DataFrame, max_records: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and problems of snapshot documents (``path``, ``text``).

    Values keep their JSON type while they are checked: a line is an integer
    or null, everything else a string.
    """
    doc = texts.withColumn("v", F.try_parse_json("text"))
    version = F.try_variant_get("v", "$.version", "int")
    items = F.try_variant_get("v", "$.findings", "array<variant>")
    wrong = (
        F.when(F.col("v").isNull(), F.lit("not valid JSON"))
        .when(~F.schema_of_variant("v").startswith("OBJECT"), F.lit("not a JSON object"))
        .when(F.coalesce(version, F.lit(-1)) != vocab.BASELINE_VERSION, F.lit("unsupported version"))
        .when(items.isNull(), F.lit("no findings list"))
    )
    if max_records is not None:
        wrong = wrong.when(F.size(items) > max_records, F.lit("too many records"))
    judged = doc.withColumn("problem", wrong)
    rows = judged.where("problem IS NULL").select("path", F.posexplode(items).alias("pos", "item"))

    def kind(field: str):
        # a field that is absent and one that is null are the same here
        value = F.try_variant_get("item", f"$.{field}", "variant")
        return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))

    checked = rows.withColumn(
        "problem",
        F.when(~F.schema_of_variant("item").startswith("OBJECT"), F.lit("record is not an object"))
        .when(~kind("line").isin("BIGINT", "VOID"), F.lit("record has a non-integer line"))
        .when(kind("rule_id") != "STRING", F.lit("record has a non-string rule_id"))
        .when(kind("file") != "STRING", F.lit("record has a non-string file"))
        .when(kind("evidence") != "STRING", F.lit("record has a non-string evidence"))
        .when(kind("severity") != "STRING", F.lit("record has a non-string severity")),
    )
    problems = judged.where("problem IS NOT NULL").select("path", F.lit(None).cast("int").alias("pos"), "problem").unionByName(
        checked.where("problem IS NOT NULL").select("path", "pos", "problem")
    )
    good = checked.where("problem IS NULL").select(
        "path",
        *[F.try_variant_get("item", f"$.{c}", "int" if c == "line" else "string").alias(c) for c in KEY],
    )
    return good, problems


def read_snapshot(spark: SparkSession, path: str, max_bytes: int | None = None, max_records: int | None = None) -> DataFrame:
    """Records of one snapshot file, refused when it is malformed or beyond a named bound."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.max("length").alias("n")).first().n
    if size is None:
        raise SnapshotError(f"baseline not found: {path}")
    if max_bytes is not None and size > max_bytes:
        raise SnapshotError(f"baseline is too large: {size} bytes (limit {max_bytes})")
    texts = files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"))
    good, problems = parse_snapshot(texts, max_records)
    bad = problems.limit(5).collect()
    if bad:
        raise SnapshotError("; ".join(r.problem for r in bad))
    return good.select(*KEY)


def snapshot_lines(records: DataFrame) -> DataFrame:
    """One JSON document with the sorted records as ordered lines: (section, rank, value).

    Ranks are counted per (rule, file) and shifted by the records of the ones before.
    """
    fields = F.to_json(F.struct(*[F.col(c) for c in KEY]), {"ignoreNullFields": "false"})
    rows = records.select(*KEY, F.lit(1).alias("section"), fields.alias("value"), F.col("line").isNotNull().alias("known"), F.coalesce("line", F.lit(0)).alias("at"))
    placed = ranked(rows, ["section"], ["known", "at", "evidence", "severity"], F.struct("rule_id", "file"))
    body = placed.select("section", "rank", F.when(F.col("rank") > 1, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))
    ends = constant_table(records.sparkSession, ["section", "rank", "value"], [(0, 0, f'{{"version": {vocab.BASELINE_VERSION}, "findings": ['), (2, 0, "]}")])
    return body.unionByName(ends).orderBy("section", "rank")


def write_records(records: DataFrame, path: str) -> None:
    """Sorted fingerprints as JSON lines, for scans of any size."""
    sorted_records(records).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_records`` wrote, of any size; a line that is no record stops the job."""
    schema = "rule_id string, file string, line int, evidence string, severity string"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).select(*KEY)


def write_snapshot(records: DataFrame, path: str) -> None:
    """One snapshot document as a text file; the sorted lines stream through its one writer."""
    snapshot_lines(records).select("value").coalesce(1).write.mode("overwrite").text(path)
