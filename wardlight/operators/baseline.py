"""Fingerprints of findings, and the multiset difference between two scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.operators.targets import by_target
from wardlight.session import cut

KEY = ["rule_id", "file", "line", "evidence", "severity"]
# fixed values
TOKEN = r"[^\s,;()\[\]{}\"'<>]+"
ABSOLUTE = r"(?<![\w:/.~+-])/(?:[A-Za-z0-9._~+-]++/(?=[A-Za-z0-9._~+-]))*+([A-Za-z0-9._~+-]++)"
UP_PREFIX = r"(?:^|(?<=[\s\"'=(,:;]))(?:\.\./)++"
UP_TOKEN = r"(?<![\w.])\.\.(?![\w.])"


def normal_path(path: Column, cwd: str = "/") -> Column:
    """Absolute path without empty, ``.`` and ``..`` segments."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), path))
    plain = F.regexp_replace(F.regexp_replace(full, r"/(?:\.?/)++", "/"), r"/\.?$", "")
    plain = F.when(plain == "", F.lit("/")).otherwise(plain)
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(F.substring(plain, F.lit(2), F.length(plain)), "/"),
        empty,
        lambda acc, part: F.when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, part)),
    )
    return F.when(plain.rlike(r"/\.\.(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(plain)


def _folder(root: str | Column) -> Column:
    """A folder with a slash at its end, so that it is a prefix of what lies below only."""
    return F.concat(F.rtrim(root, F.lit("/")), F.lit("/")) if isinstance(root, Column) else F.lit(root.rstrip("/") + "/")


def relative_location(file: Column, root: str | Column, cwd: str = "/") -> Column:
    """Location below the scan root; pseudo locations stay, anything outside is named by its base name.

    A null root has nothing below it.
    """
    full, base = normal_path(file, cwd), _folder(root)
    inside = F.when(full.startswith(base), F.substring(full, F.length(base) + 1, F.length(full)))
    outside = F.concat(F.lit("<outside>/"), F.regexp_extract(full, r"([^/]*)$", 1))
    return F.when(file.startswith("<") & file.endswith(">"), file).otherwise(F.coalesce(inside, outside))


@by_target()
def rooted(rows: DataFrame, roots: DataFrame, keys: Sequence[str] = (), column: str = "path", cwd: str = "/") -> DataFrame:
    """Adds ``root``: of the target's roots (keys, root) the longest that holds the path, null where none does.

    Every distinct path meets the roots by its leading folders, no deeper than the deepest root, so the
    number of roots does not matter and a target with most files is spread by its paths.
    """
    rows = cut(rows)  # read for the distinct paths and again for the result
    known = roots.where("root IS NOT NULL").select(*keys, normal_path(F.col("root"), cwd).alias("root")).distinct()
    deepest = known.agg(F.max(F.size(F.split("root", "/")))).first()[0] or 0
    parts = F.split(F.concat(F.rtrim("_full", F.lit("/")), F.lit("/")), "/")  # the first part is empty, the last too
    heads = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(max(deepest, 1)))), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    files = rows.select(*keys, column).where(F.col(column).isNotNull()).distinct().withColumn("_full", normal_path(F.col(column), cwd))
    met = files.select(*keys, column, F.explode(heads).alias("root")).join(known, [*keys, "root"])
    found = met.groupBy(*keys, column).agg(F.max_by("root", F.length("root")).alias("root"))
    return rows.drop("root").join(found, [*keys, column], "left").select(*[c for c in rows.columns if c != "root"], "root")


def sanitize_evidence(evidence: Column, root: str | Column, home: str = "", cwd: str = "") -> Column:
    """Evidence without host paths; URLs stay as written."""
    pieces = F.regexp_extract_all(evidence, F.lit(rf"({TOKEN}|[\s,;()\[\]{{}}\"'<>]+)"), F.lit(1))

    def scrub(token: Column) -> Column:
        place = F.regexp_replace(token, r":\d+$", "")
        tail = F.substring(token, F.length(place) + 1, F.length(token))
        return F.when(token.startswith("/") & ~token.contains("://"), F.concat(relative_location(place, root), tail)).otherwise(token)

    text = F.when(evidence.contains("/"), F.array_join(F.transform(pieces, scrub), "")).otherwise(evidence)
    for prefix, by in ((root, ""), (home, "<home>/"), (cwd, "<cwd>/")):
        lead = _folder(prefix)
        text = F.when(lead != "/", F.replace(text, lead, F.lit(by))).otherwise(text)
    text = F.regexp_replace(text, ABSOLUTE, "<path>/$1")
    text = F.regexp_replace(text, UP_PREFIX, "")
    return F.regexp_replace(text, UP_TOKEN, "<up>")


def rewrite_known_files(findings: DataFrame, files: DataFrame, root: str, cwd: str, id_column: str) -> DataFrame:
    """Rewrite relative file names inside evidence, for scans whose paths are relative.

    Every token is looked up in the file table by a join, so the number of
    files does not matter.
    """
    findings = cut(findings)  # read for the tokens and again for the result
    known = files.select(F.col("path").alias("_place"), relative_location(F.col("path"), root, cwd).alias("_to")).distinct()
    pieces = F.regexp_extract_all(F.col("evidence"), F.lit(rf"({TOKEN}|[\s,;()\[\]{{}}\"'<>]+)"), F.lit(1))
    tokens = findings.select(id_column, F.posexplode(pieces).alias("_pos", "_token"))
    tokens = tokens.withColumn("_place", F.regexp_replace("_token", r":\d+$", "")).withColumn(
        "_tail", F.substring(F.col("_token"), F.length("_place") + 1, F.length("_token"))
    )
    said = F.when(F.col("_to").isNotNull() & ~F.col("_token").contains("://"), F.concat("_to", "_tail")).otherwise(F.col("_token"))
    joined = (
        tokens.join(known, "_place", "left")
        .groupBy(id_column)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", said.alias("t")))).alias("_all"))
        .select(id_column, F.array_join(F.transform("_all", lambda x: x["t"]), "").alias("_evidence"))
    )
    return findings.join(joined, id_column, "left").withColumn("evidence", F.coalesce("_evidence", "evidence")).drop("_evidence")


def records(findings: DataFrame, root: str | Column, cwd: str = "/", home: str = "") -> DataFrame:
    """Findings with scrubbed ``file`` and ``evidence``; suppressed ones included."""
    return findings.withColumn("file", relative_location(F.col("path"), root, cwd)).withColumn(
        "evidence", sanitize_evidence(F.coalesce("evidence", F.lit("")), root, home, cwd)
    )


def sorted_records(rows: DataFrame) -> DataFrame:
    """The five fingerprint columns in file order, lines unknown first."""
    # a sort reads its input twice, for the bounds of its ranges and for the rows
    return cut(rows.select(*KEY)).orderBy("rule_id", "file", F.asc_nulls_first("line"), "evidence", "severity")


def _same(keys: Sequence[str]) -> Column:
    cond = F.col(f"l.{keys[0]}").eqNullSafe(F.col(f"r.{keys[0]}"))
    for k in keys[1:]:
        cond &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return cond


def matched_counts(current: DataFrame, baseline: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Per key: rows now, rows then, matched = the smaller. Counted before shuffling."""
    now = current.groupBy(*keys).agg(F.count("*").alias("n_current"))
    then = baseline.groupBy(*keys).agg(F.count("*").alias("n_baseline"))
    both = now.alias("l").join(then.alias("r"), _same(keys), "full_outer")
    a, b = F.coalesce("n_current", F.lit(0)), F.coalesce("n_baseline", F.lit(0))
    chosen = [
        F.when(F.col("n_current").isNotNull(), F.col(f"l.{k}")).otherwise(F.col(f"r.{k}")).alias(k) for k in keys
    ]
    return both.select(*chosen, a.alias("n_current"), b.alias("n_baseline"), F.least(a, b).alias("matched"))


def diff_counts(current: DataFrame, baseline: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    counts = matched_counts(current, baseline, keys)
    return counts.agg(
        F.sum("matched").alias("matched"),
        F.sum(F.col("n_current") - F.col("matched")).alias("new"),
        F.sum(F.col("n_baseline") - F.col("matched")).alias("fixed"),
    )


def count_keys(baseline: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """A baseline as (key, n_baseline): what comparisons read, once per baseline."""
    return baseline.groupBy(*keys).agg(F.count("*").alias("n_baseline"))


def annotate(current: DataFrame, baseline: DataFrame, order: Sequence[str], chunk: Column,
             keys: Sequence[str] = KEY, excluded: Column | None = None) -> DataFrame:
    """Adds ``baseline_state``: the first matched rows of a key in scan order, the rest new.

    ``baseline`` holds fingerprints, or ``n_baseline`` per key. Rows are numbered inside
    (key, chunk) and meet the baseline as one row per (key, chunk), which carries the count of
    the chunks before it; ``chunk`` must grow with the order. So no step, the join included, has
    a frequent key in one task. ``excluded`` rows were not compared and keep null.
    """
    rows = current.withColumn("_skip", F.lit(False) if excluded is None else excluded)
    compared, skipped = rows.where(~F.col("_skip")), rows.where("_skip")
    marked = compared.withColumn("_chunk", chunk)
    place = [*keys, "_chunk"]
    then = baseline if "n_baseline" in baseline.columns else count_keys(baseline, keys)
    sizes = marked.groupBy(*place).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    told = offsets.alias("l").join(then.alias("r"), _same(keys), "left").select(
        *[F.col(f"l.{k}") for k in place], "l._before", F.coalesce("r.n_baseline", F.lit(0)).alias("_then")
    )
    inside = W.partitionBy(*place).orderBy(*order)
    numbered = marked.withColumn("_rn", F.row_number().over(inside))
    state = F.when(F.col("l._rn") + F.col("r._before") <= F.col("r._then"), F.lit("matched")).otherwise(F.lit("new"))
    judged = numbered.alias("l").join(told.alias("r"), _same(place)).select(*[F.col(f"l.{c}") for c in current.columns], state.alias("baseline_state"))
    return judged.unionByName(skipped.withColumn("baseline_state", F.lit(None).cast("string")).select(*judged.columns))


def fixed_rows(current: DataFrame, baseline: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Baseline rows without a counterpart, each as often as it is missing."""
    counts = matched_counts(current, baseline, keys).where("n_baseline > matched")
    missing = (F.col("n_baseline") - F.col("matched")).cast("int")
    return counts.select(*keys, F.explode(F.sequence(F.lit(1), missing)).alias("_copy")).drop("_copy")


def finding_id(rule_id: Column, file: Column, line: Column, evidence: Column, severity: Column) -> Column:
    """``fnd-`` and twelve hex digits over the escaped fingerprint."""
    def escape(text: Column) -> Column:
        plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        return F.replace(plain, F.lit(vocab.FIELD_SEP), F.lit("\\x1f"))

    fields = [escape(rule_id), escape(file), F.coalesce(line.cast("string"), F.lit("")), escape(evidence), escape(severity)]
    return F.concat(F.lit("fnd-"), F.left(F.sha2(F.concat_ws(vocab.FIELD_SEP, *fields), 256), F.lit(12)))


def with_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("finding_id", finding_id(*[F.col(c) for c in KEY]))


def resolve(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Each wanted id with the number of records it names and, where that is one, the record's fields."""
    fields = [c for c in rows.columns if c != column]
    wanted = cut(wanted.select(column).distinct())
    found = rows.join(wanted, column, "left_semi").groupBy(column).agg(
        F.count("*").alias("n_records"), F.min(F.struct(*fields)).alias("r")
    )
    one = F.col("n_records") == 1
    return wanted.join(found, column, "left").select(
        column, F.coalesce("n_records", F.lit(0)).alias("n_records"), *[F.when(one, F.col(f"r.{c}")).alias(c) for c in fields]
    )


def lookup(rows: DataFrame, column: str, wanted: str):
    """The one record with this id; none or several is an error."""
    hits = rows.where(F.col(column) == wanted).limit(2).collect()
    if len(hits) != 1:
        raise LookupError(f"{wanted}: {'no record' if not hits else 'several records'}")
    return hits[0]


def ambiguous_ids(rows: DataFrame, column: str) -> DataFrame:
    """Ids that name more than one record."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
