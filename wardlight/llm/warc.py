"""WARC archives written and read back with boundary-chain verification.

Writing is Spark's text writer: a row is one record, the line separator is the CRLF CRLF that
ends a record, so the part files are archives. Equal payloads are stored once; the others are
revisit records that name the response.

Reading splits archives at the magic line, wherever it occurs, over as many tasks as there are
splits. A piece yields a candidate: its offset (prefix sums over pieces, splits and files) and
the offset its header claims for the successor. Candidates whose claim is the next candidate
form runs; a run is one pointer to the place its last record claims. Pointer jumping over the
entries of runs, from offset 0 of each file, doubles its reach every round. Only records that
the chain reaches are records; a magic line, or a whole record, inside a payload is not reached
and its bytes go back to the payload that holds it.

Defined results: null html is the empty payload; a null or repeated page_id keeps a record per
row; of rows tied for the largest page_id of a payload all are responses. White space and
control characters in a URL are written as %XX; a null URL leaves the header out. An archive whose chain breaks
loses what follows the break, up to the end of that file (``verify`` counts it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import Scratch, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
RECORDS_PER_FILE = 20_000
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits make four letters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def plan_records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, n, digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"), base32_sha1(payload.cast("binary")).alias("digest"),
    )
    firsts = rows.filter(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = firsts.filter((F.col("copies") > 1) & F.col("first").isNotNull()).drop("copies")
    later = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    return rows.join(firsts, ["digest", "n"], "left").withColumn("refers_to", F.when(later, F.col("first"))).drop("first")


def _name(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def record_text(date: str) -> Column:
    """One record without its closing CRLF CRLF, which the writer adds."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    clean = F.expr(r"regexp_replace(regexp_replace(url, '\r', '%0D'), '\n', '%0A')")
    clean = F.regexp_replace(F.regexp_replace(clean, " ", "%20"), r"[\x00-\x1f\x7f]", "%00")
    length = F.when(revisit, F.lit(0)).otherwise(F.octet_length(http) + F.col("n"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _name(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}"),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), clean)),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _name(F.col("refers_to")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: "), F.when(revisit, F.lit("message/http")).otherwise(F.lit("application/http; msgtype=response")),
        F.lit("\r\nContent-Length: "), length.cast("string"), F.lit(END),
    )
    return F.when(revisit, head).otherwise(F.concat(head, http, F.col("payload")))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE, codec: str = "gzip") -> None:
    """``plan_records`` rows as archives below ``folder``; rewriting replaces them.

    Compressed archives are read a file at a time, which ``records_per_file`` bounds; plain
    ones (``codec="none"``) are read in splits. Offsets are those of the plain bytes.
    """
    lines = records.select(record_text(date).alias("value"))
    lines.write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", codec).text(folder)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?:^|\r\n){name}: *([^\r\n]*)", 1), F.lit(""))


def pieces(spark: SparkSession, folder: str, *columns: Column) -> DataFrame:
    """What lies between magic lines: file, file_size, offset of the magic line and ``columns``.

    ``columns`` may use ``bytes`` (the piece after its magic line), ``size``, ``header``, ``head``
    (bytes of the header with its end) and ``claim`` (its Content-Length).
    """
    read = spark.read.option("lineSep", MAGIC).text(folder).withColumn("gap", F.locate(END, F.col("value")))
    raw = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("turn"), F.col("value").cast("binary").alias("bytes"),
        F.when(F.col("gap") > 0, F.expr("substring(value, 1, gap - 1)")).alias("header"),
    )
    raw = raw.withColumn("size", F.octet_length("bytes").cast("long")).withColumn("claim", _field("Content-Length").try_cast("long"))
    raw = raw.withColumn("head", F.octet_length("header") + len(END))
    kept = raw.select("file", "block", "turn", "size", *columns)
    spans = kept.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("span"))
    start = F.coalesce(F.sum("span").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    end = F.sum("span").over(W.partitionBy("file")) - len(MAGIC)
    starts = spans.select("file", "block", start.alias("start"), end.alias("file_size"))
    before = W.partitionBy("file", "block").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(before), F.lit(0))
    placed = kept.withColumn("inner", inner).join(starts, ["file", "block"])
    placed = placed.withColumn("offset", F.col("start") + F.col("inner") - len(MAGIC))
    return placed.filter(F.col("offset") >= 0).drop("start", "inner", "block", "turn")


def _payload(block: Column) -> list[Column]:
    """Length and digest of the payload: the HTTP body, or the block where it has no HTTP head."""
    text = block.cast("string")
    http = F.coalesce(text.startswith("HTTP/"), F.lit(False)) & (F.locate(END, text) > 0)
    skip = F.when(http, F.octet_length(F.substring_index(text, END, 1)) + len(END)).otherwise(F.lit(0))
    payload = F.substring(block, skip + 1, F.octet_length(block))
    return [F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest")]


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate records: file, file_size, offset, successor (null without a usable header), fields.

    The payload is measured where the piece is exactly the record that its header claims.
    """
    whole = F.col("size") == F.col("head") + F.col("claim") + len(END)
    block = F.when(whole, F.substring(F.col("bytes"), F.col("head") + 1, F.col("claim").cast("int")))
    found = pieces(
        spark, folder, "head", "claim", _field("WARC-Type").alias("type"), _field("WARC-Record-ID").alias("record"),
        _field("WARC-Refers-To").alias("refers"), _field("WARC-Payload-Digest").alias("declared"),
        _field("X-Payload-Length").try_cast("long").alias("declared_bytes"), F.coalesce(whole, F.lit(False)).alias("whole"), *_payload(block),
    )
    claimed = F.col("offset") + len(MAGIC) + F.col("head") + F.col("claim") + len(END)
    return found.withColumn("successor", F.when(claimed <= F.col("file_size"), claimed))


def reachable(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The candidates that the chain from offset 0 of their file reaches, by pointer jumping."""
    in_file = W.partitionBy("file").orderBy("offset")
    linked = found.withColumn("joined", F.coalesce(F.lag("successor").over(in_file) == F.col("offset"), F.lit(False)))
    runs = linked.withColumn("run", F.sum((~F.col("joined")).cast("long")).over(in_file))
    last = F.last("successor").over(W.partitionBy("file", "run").orderBy("offset").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    runs = scratch.write(runs.withColumn("exit", last).drop("joined"), "runs")
    targets = runs.select("file", F.col("exit").alias("offset")).filter("offset is not null").distinct()
    zero = runs.filter("offset = 0").select("file", "offset")
    entries = runs.select("file", "offset", "run", "exit").join(targets.unionByName(zero).distinct(), ["file", "offset"])
    entries = scratch.write(entries, "entries")
    hops = entries.select("file", "offset", F.col("exit").alias("to")).filter("`to` is not null")
    hops = hops.join(entries.select("file", F.col("offset").alias("to")), ["file", "to"])
    longest = hops.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reached, reach, turn = zero, 1, 0
    while reach <= longest:
        step = reached.join(hops, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = scratch.write(reached.unionByName(step).distinct(), f"reached{turn}")
        far = hops.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond"))
        hops = scratch.write(hops.join(far, ["file", "to"]).select("file", "offset", F.col("beyond").alias("to")), f"hops{turn}")
        reach, turn = reach * 2, turn + 1
    firsts = entries.join(reached, ["file", "offset"]).groupBy("file", "run").agg(F.min("offset").alias("entry"))
    return runs.join(firsts, ["file", "run"]).filter(F.col("offset") >= F.col("entry")).drop("run", "exit", "entry")


def read_archives(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """Records of the archives: file, offset, type, record, refers, declared, declared_bytes, payload_bytes, payload_digest."""
    real = scratch.write(reachable(candidates(spark, folder), scratch), "real")
    columns = ["file", "offset", "type", "record", "refers", "declared", "declared_bytes", "payload_bytes", "payload_digest"]
    complete, broken = real.filter("whole").select(*columns), real.filter("not whole and successor is not null")
    if broken.limit(1).count() == 0:
        return complete
    files = broken.select("file").distinct()
    owners = real.filter("successor is not null").select("file", F.col("offset").alias("owner"), F.col("whole").alias("single"))
    parts = pieces(spark, folder, "bytes").join(files, "file", "left_semi")
    marked = parts.join(owners, (parts["file"] == owners["file"]) & (parts["offset"] == owners["owner"]), "left").select(parts["file"], "offset", "bytes", "owner", "single")
    latest = W.partitionBy("file").orderBy("offset")
    owned = marked.withColumn("start", F.last("owner", True).over(latest)).withColumn("alone", F.last("single", True).over(latest)).filter(~F.col("alone"))
    joined = owned.groupBy("file", F.col("start").alias("offset")).agg(F.sort_array(F.collect_list(F.struct("offset", "bytes"))).alias("parts"))
    rest = F.expr(f"aggregate(slice(parts, 2, size(parts)), parts[0].bytes, (a, x) -> concat(a, cast('{MAGIC}' as binary), x.bytes))")
    whole = broken.drop("payload_bytes", "payload_digest").join(joined.select("file", "offset", rest.alias("bytes")), ["file", "offset"])
    block = F.substring(F.col("bytes"), F.col("head") + 1, F.col("claim").cast("int"))
    return complete.unionByName(whole.select("*", *_payload(block)).select(*columns))


def round_trip(pages: DataFrame, scratch: Scratch, id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    write_archives(plan_records(pages, id, url, html, least_bytes), scratch.path("archives"))
    back = read_archives(pages.sparkSession, scratch.path("archives"), scratch)
    page = lambda name: F.regexp_extract(name, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    revisit, declared = F.col("type") == "revisit", F.substring("declared", 6, 32)
    return back.select(
        page("record").alias("page_id"), F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, declared).otherwise(F.col("payload_digest")).alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(revisit, page("refers")).alias("refers_to"), (revisit | (F.col("payload_digest") == declared)).alias("intact"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = " || ".join(
    f"substr('{BASE32}', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31)::BIGINT + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p
"""
