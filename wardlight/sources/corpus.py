"""From files or text tables to documents and lines, with an account of what was not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.session import set_of

FILE_COLUMNS = ["path", "length", "content"]


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` with its bytes; content is read only where it is used."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "content")
    )


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def admitted_by_name(path: Column) -> Column:
    name = base_name(path)
    ending = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    return name.isin(vocab.ALWAYS_SCAN) | ending.isin(vocab.SCAN_EXTENSIONS)


def _folders(path: Column, root: str) -> Column:
    relative = F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)
    parts = F.split(F.ltrim(relative, F.lit("/")), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _pruned_at(folders: Column) -> Column:
    """1-based position of the first folder that is not entered, null when all are."""
    banned = set_of(vocab.MACHINE_DIRS + vocab.VENDORED_DIRS)
    places = F.transform(folders, lambda f, i: F.when(F.array_contains(banned, f), i + 1))
    return F.array_min(F.array_compact(places))


def prune(files: DataFrame, root: str = "", links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split off files below folders that are not entered.

    Returns the files left and one row per pruned folder. ``links`` may list
    symbolic folder links (``path``), which a file source cannot see.
    """
    marked = files.withColumn("_folders", _folders(F.col("path"), root)).withColumn(
        "_at", _pruned_at(F.col("_folders"))
    )
    name = F.get(F.col("_folders"), F.col("_at") - 1)
    reason = F.when(name.isin(vocab.VENDORED_DIRS), F.lit("vendored_dir")).otherwise(F.lit("ignored_dir"))
    pruned = (
        marked.where(F.col("_at").isNotNull())
        .select(
            F.concat(F.lit(root), F.array_join(F.slice("_folders", F.lit(1), F.col("_at")), "/")).alias("path"),
            reason.alias("reason"),
        )
        .distinct()
    )
    if links is not None:
        pruned = pruned.unionByName(
            links.select("path", F.lit("symlink_dir").alias("reason")).distinct()
        )
    return marked.where(F.col("_at").isNull()).drop("_folders", "_at"), pruned


def decode(files: DataFrame, max_bytes: int | None = None, probe_bytes: int | None = None) -> DataFrame:
    """Adds ``text``, ``skip_reason`` and ``lossy`` by name, size and bytes.

    Files are read whole, whatever their size, and judged by all their bytes, unless a
    caller names bounds: ``max_bytes`` refuses larger files (``too_large`` in the account),
    ``probe_bytes`` looks for zero bytes at the start only. A zero byte means binary, unless a byte-order mark declares
    the file as text and the body decodes strictly. Bytes that are not UTF-8
    are still read, with replacement characters, and reported as lossy.
    """
    content, raw = F.col("content"), F.col("content").cast("string")
    head = F.hex(F.substring(content, F.lit(1), F.lit(4)))
    charset = (
        F.when(head.startswith("FFFE0000") | head.startswith("0000FEFF"), F.lit("UTF-32"))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.lit("UTF-16"))
    )
    looked_at = "content" if probe_bytes is None else f"substring(content, 1, {int(probe_bytes)})"
    zero = F.expr(f"position(x'00', {looked_at}) > 0")
    refused = F.when(~admitted_by_name(F.col("path")), F.lit("not_scannable"))
    if max_bytes is not None:
        refused = refused.when(F.col("length") > max_bytes, F.lit("too_large"))
    declared = F.when(F.col("_charset") == "UTF-32", _strict(content, "UTF-32")).when(
        F.col("_charset") == "UTF-16", _strict(content, "UTF-16")
    )
    # unfolded from arrays of one: a filter on these columns would be pushed below a projection and decode again
    marked = (
        files.withColumn("_refused", refused)
        .withColumn("_charset", F.when(F.col("_refused").isNull() & zero, F.coalesce(charset, F.lit("none"))))
        .select("*", F.explode(F.array(declared)).alias("_declared"))
        .withColumn(
            "skip_reason",
            F.coalesce("_refused", F.when(F.col("_charset").isNotNull() & F.col("_declared").isNull(), F.lit("binary"))),
        )
        .withColumn("_plain", F.col("skip_reason").isNull() & F.col("_charset").isNull())
    )
    return (
        marked.select("*", F.explode(F.array(F.when(F.col("_plain"), F.make_valid_utf8(raw)).otherwise(F.col("_declared")))).alias("text"))
        .withColumn("lossy", F.when(F.col("_plain"), ~F.is_valid_utf8(raw)).otherwise(F.lit(False)))
        .drop("_refused", "_charset", "_declared", "_plain", "content")
    )


# Whole bodies in hex, unit by unit: (high byte first, low byte first). Units are no halves of a pair or both halves.
_UNITS = {
    "UTF-16": (r"(?:[^D]...|D[0-7]..|D[89AB]..D[C-F]..)*+", r"(?:..[^D].|..D[0-7]|..D[89AB]..D[C-F])*+"),
    "UTF-32": (r"(?:0000(?!D[89A-F])....|000[1-9A-F]....|0010....)*+", r"(?:..(?!D[89A-F])..0000|....(?:0[1-9A-F]|10)00)*+"),
}


def _strict(content: Column, charset: str) -> Column:
    """Decoded text behind a byte-order mark, or null when the body is not valid.

    ``decode`` raises on malformed input, so the code units are checked first, written in hex.
    """
    big, little = (f"^{units}$" for units in _UNITS[charset])

    def sound(raw: Column) -> Column:
        return F.when(raw.startswith("FEFF") | raw.startswith("0000FEFF"), raw.rlike(big)).otherwise(raw.rlike(little))

    return F.when(tx.once(F.hex(content), sound), F.decode(content, charset))


def excluded(files: DataFrame, exclude: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop files a caller named (``path``); each leaves a coverage row."""
    names = exclude.select("path").distinct()
    left = files.join(names, "path", "left_anti")
    skipped = files.select("path").join(names, "path", "left_semi").select(
        "path", F.lit("baseline_snapshot").alias("reason")
    )
    return left, skipped


def coverage_events(decoded: DataFrame, pruned: DataFrame, skipped: DataFrame | None = None,
                    errors: DataFrame | None = None) -> DataFrame:
    """One row per thing read or not read: kind, path, reason, line."""
    kind = (
        F.when(F.col("skip_reason").isNotNull(), F.lit("skipped"))
        .when(F.col("lossy"), F.lit("decode_error"))
        .otherwise(F.lit("scanned"))
    )
    no_line = F.lit(None).cast("int").alias("line")
    events = decoded.select(
        kind.alias("kind"), "path",
        F.when(F.col("lossy"), F.lit("decode_error")).otherwise(F.col("skip_reason")).alias("reason"),
        no_line,
    ).unionByName(pruned.select(F.lit("pruned").alias("kind"), "path", "reason", no_line))
    if skipped is not None:
        events = events.unionByName(skipped.select(F.lit("skipped").alias("kind"), "path", "reason", no_line))
    if errors is not None:
        events = events.unionByName(
            errors.select(F.lit("rule_error").alias("kind"), "path", "reason", "line")
        )
    return events


def documents_of(decoded: DataFrame) -> DataFrame:
    """Readable documents of a decoded file table."""
    return decoded.where(F.col("text").isNotNull()).select(
        F.xxhash64("path").alias("doc_id"), "path", "text"
    )


def explode_lines(docs: DataFrame, pattern: str = tx.LINE_BREAK) -> DataFrame:
    """One row per line with its 1-based number; every other column is kept."""
    kept = [c for c in docs.columns if c != "text"]
    parts = F.posexplode(tx.split_lines(F.col("text"), pattern)).alias("_pos", "text")
    return docs.where("text <> ''").select(*kept, parts).select(*kept, (F.col("_pos") + 1).alias("line"), "text")


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the input comes in fewer splits than there are cores.

    A table of a few files, each one row group, is read by as many tasks; its rows are
    dealt out once. Inputs with splits enough are left alone. The rows are the same.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a text table, spread over all cores when the table is small."""
    return spread(read_table(spark, folder, name).select(*columns))
