"""Merkle manifest of a table, with a proof for every row by pointer jumping.

Every row is a leaf. The leaves of a source, in id order, are hashed in runs of ``fan`` until one
node is left, the source's subroot; the subroots, in source order, give the root in the same way.

Places in a source come from a range partition of all leaves: leaves are counted by chunk and the
counts summed up, so a source that holds a third of the rows is no task of its own. Trees grow a
level a job, each level a written table. Every node then holds a pointer to an ancestor and the
sibling segments on the way there, at first its parent and its own siblings. Each turn joins the
nodes with themselves: a node takes over its ancestor's pointer and appends its segments, so the
distance doubles, and nodes whose height is no multiple of the distance are never asked again and
left out. After about log2(height) turns every leaf points at its subroot; the subroots go through
the same turns towards the root, and a last join by source puts the two halves together.

Defined results: a digest is SHA-256 in lower-case hex, of the inputs one behind the other, digests as hex
text. A field is ``-`` if null, else its UTF-8 length, ``:``, its value. Null ids come first, equal ids in
the order of their digests; rows equal in all fields are leaves of their own with the same digest (and
proofs of their own places). The null source comes first. A lone leaf is its subroot and a lone subroot the root; where a
proof has no siblings its digest is that of the empty text. An empty table gives an empty result.
Texts of any length are hashed whole. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import Scratch, table

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NOTHING = "cast('' as binary)"


def digest(bytes_: Column) -> Column:
    """SHA-256, as bytes, of the lower-case hex text of ``bytes_``."""
    return F.unhex(F.sha2(F.lower(F.hex(bytes_)), 256))


def leaf(values: Sequence[Column]) -> Column:
    """The digest, as bytes, of a row's fields."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def folded(path: Column, start: Column) -> Column:
    """The digest reached from ``start`` along the siblings of ``path``."""
    return F.aggregate(path, start, lambda got, run: digest(F.concat(run["before"], got, run["after"])))


def proof_digest(path: Column) -> Column:
    """The digest, as bytes, of all siblings of ``path`` in order."""
    return digest(F.aggregate(path, F.expr(_NOTHING), lambda got, run: F.concat(got, run["before"], run["after"])))


def _placed(leaves: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(g, id, digest, body) -> (g, pos, n, digest, body): places from 0 in the order of (id, digest)."""
    numbered = scratch.write(leaves.withColumn("row", F.monotonically_increasing_id()), f"{name}-leaves")
    ranged = numbered.repartitionByRange("g", "id", "digest", "row").withColumn("chunk", F.spark_partition_id())
    ranged = scratch.write(ranged, f"{name}-ranged")
    sizes = ranged.groupBy("g", "chunk").agg(F.count(F.lit(1)).alias("size"))
    whole = W.partitionBy("g")
    starts = sizes.select("g", "chunk", (F.sum("size").over(whole.orderBy("chunk")) - F.col("size")).alias("start"), F.sum("size").over(whole).alias("n"))
    own = F.row_number().over(W.partitionBy("g", "chunk").orderBy("id", "digest", "row")) - 1
    placed = ranged.withColumn("own", own).join(starts, ["g", "chunk"])
    return scratch.write(placed.select("g", (F.col("start") + F.col("own")).alias("pos"), "n", "digest", "body"), f"{name}-placed")


def _tree(level: DataFrame, scratch: Scratch, name: str, fan: int) -> tuple[DataFrame, DataFrame, int]:
    """The nodes with pointers to their parents, the tops (g, top), and the height of the largest tree."""
    lone = level.filter("n = 1")
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    nodes = lone.select("g", F.lit(0).alias("h"), "pos", "digest", "body", none.alias("path"), F.lit(0).alias("up_h"), F.col("pos").alias("up"), F.col("digest").alias("top"), F.lit(True).alias("done"))
    tops = lone.select("g", F.col("digest").alias("top"))
    left, height = level.agg(F.max("n")).first()[0] or 0, 0
    while left > 1:
        run = F.array_sort(F.collect_list(F.struct("pos", "digest", "body")))
        runs = level.filter("n > 1").groupBy("g", F.expr(f"pos div {fan}").alias("up")).agg(F.max("n").alias("n"), run.alias("run"))
        joined = lambda part: F.aggregate(part, F.expr(_NOTHING), lambda got, child: F.concat(got, child["digest"]))
        runs = scratch.write(runs.withColumn("made", digest(joined(F.col("run")))), f"{name}-level-{height}")
        each = runs.select("g", "up", "n", "run", "made", F.posexplode("run").alias("at", "child"))
        siblings = F.array(F.struct(joined(F.expr("slice(run, 1, at)")).alias("before"), joined(F.expr("slice(run, at + 2, size(run))")).alias("after")))
        last = F.col("n") <= fan
        nodes = nodes.unionByName(
            each.select("g", F.lit(height).alias("h"), "child.pos", "child.digest", "child.body", siblings.alias("path"), F.lit(height + 1).alias("up_h"), "up", F.col("made").alias("top"), last.alias("done"))
        )
        tops = tops.unionByName(runs.filter(last).select("g", F.col("made").alias("top")))
        body = F.lit(None).cast(level.schema["body"].dataType).alias("body")
        level = runs.select("g", F.col("up").alias("pos"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.col("made").alias("digest"), body)
        left, height = -(-left // fan), height + 1
    return nodes, tops, height


def _jumped(nodes: DataFrame, scratch: Scratch, name: str, height: int) -> DataFrame:
    """The leaves with their whole paths: every turn doubles the distance of the pointers."""
    reach = 1
    nodes = scratch.write(nodes, f"{name}-jump-{reach}")
    while reach < height:
        asked = nodes.filter(F.col("h") % (2 * reach) == reach).select("g", F.col("h").alias("up_h"), F.col("pos").alias("up"), F.col("path").alias("more"), F.col("up_h").alias("far_h"), F.col("up").alias("far"), F.col("top").alias("far_top"), F.col("done").alias("far_done"))
        kept = nodes.filter(F.col("h") % (2 * reach) == 0)
        moved = kept.filter("not done").join(asked, ["g", "up_h", "up"]).select(
            "g", "h", "pos", "digest", "body", F.concat("path", "more").alias("path"), F.col("far_h").alias("up_h"), F.col("far").alias("up"), F.col("far_top").alias("top"), F.col("far_done").alias("done")
        )
        nodes = scratch.write(kept.filter("done").unionByName(moved), f"{name}-jump-{2 * reach}")
        scratch.drop(f"{name}-jump-{reach}")
        reach *= 2
    return nodes.filter("h = 0")


def _proven(leaves: DataFrame, scratch: Scratch, name: str, fan: int) -> tuple[DataFrame, DataFrame]:
    nodes, tops, height = _tree(_placed(leaves, scratch, name), scratch, name, fan)
    tops = scratch.write(tops, f"{name}-tops")
    found = _jumped(nodes, scratch, name, height)
    for h in range(height):
        scratch.drop(f"{name}-level-{h}")
    for spent in ("leaves", "ranged", "placed"):
        scratch.drop(f"{name}-{spent}")
    return found, tops


def manifest(rows: DataFrame, scratch: Scratch, id: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, body: Column | None = None, fan: int = FAN) -> DataFrame:
    """One row per row: id, source, body (carried along), leaf, subroot, root and path.

    ``path`` holds, level by level from the leaf to the root, the digests ``before`` and ``after`` the
    node in its run; digests are bytes. ``folded(path, leaf)`` is the root.
    """
    group = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    carried = F.struct(F.col(id).alias("id"), F.col(source).alias("source"), (F.lit(None).cast("binary") if body is None else body).alias("body"))
    leaves = rows.select(group.alias("g"), F.col(id).alias("id"), leaf([F.col(f) for f in fields]).alias("digest"), carried.alias("body"))
    lower, subroots = _proven(leaves, scratch, "rows", fan)
    above = subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("top").alias("digest"), F.col("g").alias("body"))
    upper, _ = _proven(above, scratch, "sources", fan)
    upper = upper.select(F.col("body").alias("g"), F.col("digest").alias("subroot"), F.col("path").alias("above"), F.col("top").alias("root"))
    return lower.join(upper, "g").select(
        F.col("body.id").alias("id"), F.col("body.source").alias("source"), F.col("body.body").alias("body"), F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "above").alias("path")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shaken = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    fields = [F.when(shaken, F.translate("text", "\n", "")).otherwise(F.col("text")) if f == "text" else F.col(f) for f in FIELDS]
    found = manifest(docs, Scratch(spark, "merkle"), body=leaf(fields))
    text = lambda column: F.lower(F.hex(column))
    found = found.select(
        F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text(proof_digest(F.col("path"))).alias("proof_sha256"), text(folded(F.col("path"), F.col("body"))).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _fields(text: str) -> str:
    return " || ".join(_field(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))


# crc32 bit by bit: each byte of the id is followed by seven empty steps
_CRC = """xor(4294967295, list_reduce(
  list_prepend(4294967295, flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(CAST(doc_id AS VARCHAR), '')])),
  lambda got, bits: xor(xor(got, bits) >> 1, 3988292384 * (xor(got, bits) & 1))))"""

ORACLE = f"""
WITH RECURSIVE rows_in AS (
  SELECT *, coalesce('s' || source, 'n') AS g, row_number() OVER () AS id,
         CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shaken FROM documents),
leaf AS (
  SELECT id, doc_id, g, sha256({_fields('text')}) AS h, sha256({_fields('shaken')}) AS other FROM rows_in),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaf),
low AS (
  SELECT g, 0 AS l, pos, n, h FROM placed
  UNION ALL
  SELECT g, l + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY g, l, pos // 3),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS l, pos, n, subroot AS h FROM subs
  UNION ALL
  SELECT l + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY l, pos // 3),
runs AS (
  SELECT g, l, pos // 3 AS up, list(h ORDER BY pos) AS run FROM low WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, l, pos // 3, list(h ORDER BY pos) FROM high WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT id, 0 AS half, l, run, (pos // CAST(pow(3, l) AS BIGINT)) % 3 AS spot
  FROM placed JOIN runs ON runs.g = placed.g AND up = pos // CAST(pow(3, l + 1) AS BIGINT)
  UNION ALL
  SELECT id, 1, l, run, (subs.pos // CAST(pow(3, l) AS BIGINT)) % 3
  FROM placed JOIN subs ON subs.g = placed.g JOIN runs ON runs.g IS NULL AND up = subs.pos // CAST(pow(3, l + 1) AS BIGINT)),
paths AS (
  SELECT id, list(array_to_string(list_slice(run, 1, spot), '') || '|' || array_to_string(list_slice(run, spot + 2, len(run)), '') ORDER BY half, l) AS path FROM steps GROUP BY id),
ends AS (
  SELECT placed.doc_id, placed.h AS leaf, subs.subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(path, []) AS path, other
  FROM placed JOIN subs ON subs.g = placed.g LEFT JOIN paths ON paths.id = placed.id),
done AS (
  SELECT *, list_reduce(list_prepend(other, path), lambda got, p: sha256(split_part(p, '|', 1) || got || split_part(p, '|', 2))) AS folded_root FROM ends)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
