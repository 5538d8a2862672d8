"""Ordered steps inside a document and the chains they form."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight import vocab
from wardlight.functions import text as tx
from wardlight.operators.bands import with_halo
from wardlight.operators.targets import by_target
from wardlight.session import by_merge, cut, set_of, settle

ACTION_COLUMNS = ["idx", "line", "category", "verb", "object", "destination", "output"]
_MODIFIER = "|".join(vocab.MODIFIERS)
_CONTAINER = "|".join(vocab.CONTAINERS)


def split_actions(lines: DataFrame) -> DataFrame:
    """One row per non-blank action segment of a line, in order (``seg``, ``part``)."""
    kept = [c for c in lines.columns if c != "text"]
    text = F.col("text")

    def clean(part: Column) -> Column:
        return tx.strip(tx.replace(tx.strip(part), r"^(?:and\s+then|then)\s+", "", fold=True))

    pieces = F.transform(F.split(text, tx.UNICODE_FOLD + vocab.ACTION_SEPARATOR, -1), clean)
    # most lines hold no separator and are one segment
    several = text.contains(";") | F.lower(text).contains("then")
    parts = F.array_remove(F.when(several, pieces).otherwise(F.array(tx.strip(text))), "")
    return lines.select(*kept, F.posexplode(parts).alias("seg", "part"))


def category_of(part: Column) -> Column:
    """First matching step category, in fixed priority; a pattern is tried where its fixed parts occur."""
    def judged(low: Column) -> Column:
        expr, odd = None, tx.folds_to_ascii(low)
        for name, pattern in vocab.STEP_PATTERNS:
            able = F.lit(True)
            for words in vocab.STEP_PARTS[name]:
                able &= tx.any_contains(low, words)
            cond = (able | odd) & tx.has(part, pattern, fold=True)
            expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        return expr

    return tx.once(F.lower(part), judged)


def classified(segments: DataFrame) -> DataFrame:
    """Segments that are steps, with their ``category``.

    The category is unfolded from an array: a filter on it would be pushed
    below the projection and run the patterns twice.
    """
    return segments.select("*", F.explode(F.array_compact(F.array(category_of(F.col("part"))))).alias("category"))


def normalize_object(phrase: Column) -> Column:
    """Lower case, plain characters, no leading modifiers, no trailing container words."""
    s = F.lower(tx.strip(phrase))
    s = F.regexp_replace(s, r"(?U)[^a-z0-9\s./_-]", "")
    s = tx.strip(F.regexp_replace(s, r"(?U)\s+", " "))
    s = F.rtrim(F.rtrim(s, F.lit(".")))
    s = F.regexp_replace(s, rf"^(?:(?:{_MODIFIER})(?: |$))++", "")
    return F.regexp_replace(s, rf"(?<=\S)(?: (?:{_CONTAINER})(?= |$))++$", "")


def _step_choices() -> list[list[str]]:
    """What the lower-case line of a step matches: the verbs its category's pattern starts with, as words, and its other parts.

    A boundary between ASCII words only is one wherever a Unicode boundary stands beside such a verb, and
    what lines are split at is none of their letters; lines with letters that fold to ASCII ones are all tried.
    """
    choices = []
    for name, pattern in vocab.STEP_PATTERNS:
        verbs = re.match(r"\\b\(\?:[a-z|]+\)\\b", pattern).group()
        choices.append([verbs, *[tx.any_word(words) for words in vocab.STEP_PARTS[name][1:]]])
    return [*choices, [tx.any_word(tx.FOLDED)]]


def actions(lines: DataFrame) -> DataFrame:
    """Structured actions: idx, line, category, verb, object, destination, output."""
    kept = [c for c in lines.columns if c not in ("text", "line")]
    part, rest = F.col("part"), F.col("_rest")
    able = lines.where(tx.matching(F.lower("text"), _step_choices()) != 0)
    steps = classified(split_actions(able))
    verb = F.lower(F.regexp_extract(part, r"^\s*([A-Za-z]+)", 1))
    goal = tx.first_match(rest, r"\b(?:into|to)\s+(.+)$", 1, fold=True)
    return (
        steps.withColumn("verb", verb)
        .withColumn("_rest", tx.strip(F.substring(part, F.length("verb") + 1, F.length(part))))
        .select(
            *kept,
            (F.col("line").cast("bigint") * 2**32 + F.col("seg")).alias("idx"),
            "line",
            "category",
            "verb",
            normalize_object(F.get(F.split(rest, tx.UNICODE_FOLD + vocab.OBJECT_END, 2), F.lit(0))).alias("object"),
            F.nullif(tx.strip_url_tail(F.regexp_extract(part, r"https?://[^\s'\"]+", 0)), F.lit("")).alias("destination"),
            F.when((F.col("category") == "TRANSFORM") & (goal != ""), normalize_object(goal)).alias("output"),
        )
    )


def evidence_of(categories: Sequence[str]) -> str:
    return "Sequence: " + " -> ".join(vocab.STEP_LABELS[c] for c in categories)


def _next(cond: Column, value: Column, keys: Sequence[str]) -> Column:
    """Value of the nearest later row that meets ``cond``.

    Rows are ordered backwards, so the frame only grows: one pass per group.
    """
    later = W.partitionBy(*keys, "tile").orderBy(F.col("idx").desc()).rowsBetween(W.unboundedPreceding, -1)
    return F.last(F.when(cond, value), ignorenulls=True).over(later)


def find_sequence(steps: DataFrame, keys: Sequence[str], pattern: Sequence[str], span: int = vocab.LINE_SPAN) -> DataFrame:
    """First ordered run p1 -> p2 -> p3 per group, every step within ``span`` lines of the first.

    The nearest completion of the earliest anchor wins. One row per group:
    idx and line of the three steps.
    """
    one, two, three = pattern
    rows = with_halo(steps.where(F.col("category").isin(one, two, three)).select(*keys, "idx", "line", "category"), span)
    cat = F.col("category")
    here = F.struct("idx", "line")
    found = (
        rows.withColumn("_three", _next(cat == three, here, keys))
        .withColumn("_two", _next(cat == two, F.struct("idx", "line", "_three"), keys))
        .where(
            F.col("core") & (cat == one) & F.col("_two._three").isNotNull()
            & (F.col("_two._three.line") - F.col("line") <= span)
        )
    )
    best = F.min(F.struct(
        F.col("idx").alias("idx1"), F.col("line").alias("line1"),
        F.col("_two.idx").alias("idx2"), F.col("_two.line").alias("line2"),
        F.col("_two._three.idx").alias("idx3"), F.col("_two._three.line").alias("line3"),
    ))
    return found.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.*")


def _content_words(phrase: Column) -> Column:
    dull = set_of(vocab.STOPWORDS + vocab.ACTION_WORDS)
    return F.filter(
        F.split(phrase, " "),
        lambda w: (F.length(w) >= vocab.MIN_OBJECT_WORD) & ~F.array_contains(dull, w),
    )


def with_reference(executions: DataFrame) -> DataFrame:
    """What an execution may refer to: ``free`` (any download) or some ``words``."""
    phrase = F.trim(F.col("object"), F.lit(" ."))
    kinds = set_of(vocab.ARTEFACT_KINDS)
    words = F.col("words")
    sized = F.size(words).between(1, vocab.MAX_EXEC_WORDS)
    pronoun = F.col("_phrase").isin(vocab.ANAPHORA)
    return (
        executions.withColumn("_phrase", phrase)
        .withColumn("words", F.array_distinct(_content_words(F.col("_phrase"))))
        .withColumn("_all", _content_words(F.col("_phrase")))
        .withColumn("free", pronoun | (F.size("_all").between(1, vocab.MAX_EXEC_WORDS) & F.forall("_all", lambda w: F.array_contains(kinds, w))))
        .withColumn("words", F.when(~pronoun & F.size("_all").between(1, vocab.MAX_EXEC_WORDS) & sized, words).otherwise(F.array().cast("array<string>")))
        .drop("_phrase", "_all")
    )


def same_object(downloads: DataFrame, executions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (object, word) pairs per group where the object contains the word.

    Candidates meet on a five-letter piece, the shortest length a word may
    have, so texts that share nothing are never paired.
    """
    size = vocab.MIN_OBJECT_WORD
    objects = downloads.select(*keys, "object").distinct().where(F.length("object") >= size)
    grams = objects.select(
        *keys, "object",
        F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length("object") - (size - 1)),
            lambda p: F.substring(F.col("object"), p, F.lit(size)),
        ))).alias("gram"),
    )
    words = executions.select(*keys, F.explode("words").alias("word")).distinct()
    words = words.withColumn("gram", F.left("word", F.lit(size)))
    return (
        grams.join(by_merge(words), [*keys, "gram"])
        .where(F.col("object").contains(F.col("word")))
        .select(*keys, "object", "word")
        .distinct()
    )


@by_target()
def find_download_execute(steps: DataFrame, keys: Sequence[str], span: int = vocab.LINE_SPAN) -> DataFrame:
    """First download whose object a later execution within ``span`` lines continues.

    One row per group: idx and line of both steps. No pair of steps is ever
    listed: free references and matched words look up the nearest later
    execution each.
    """
    tiled = [*keys, "tile"]
    mine = steps.where("category IN ('DOWNLOAD', 'EXECUTION')").select(*keys, "idx", "line", "category", "object")
    rows = with_halo(cut(mine), span)
    downloads = rows.where("category = 'DOWNLOAD' AND core")
    executions = with_reference(rows.where("category = 'EXECUTION'"))
    here = F.struct("idx", "line")
    plain = ["idx", "line"]

    def nearest(down: DataFrame, exe: DataFrame, group: Sequence[str]) -> DataFrame:
        both = down.select(*group, *plain, F.lit(False).alias("is_exec")).unionByName(
            exe.select(*group, *plain, F.lit(True).alias("is_exec"))
        )
        later = W.partitionBy(*group).orderBy(F.col("idx").desc()).rowsBetween(W.unboundedPreceding, -1)
        target = F.last(F.when(F.col("is_exec"), here), ignorenulls=True).over(later)
        return (
            both.withColumn("_to", target)
            .where(~F.col("is_exec") & F.col("_to").isNotNull() & (F.col("_to.line") - F.col("line") <= span))
            .select(*keys, "idx", "line", F.col("_to.idx").alias("idx2"), F.col("_to.line").alias("line2"))
        )

    matches = cut(same_object(downloads, executions, tiled))
    by_word = nearest(
        downloads.join(matches, [*tiled, "object"]).select(*tiled, "object", "word", *plain),
        executions.select(*tiled, *plain, F.explode("words").alias("word")).join(matches, [*tiled, "word"]).select(
            *tiled, "object", "word", *plain
        ),
        [*tiled, "object", "word"],
    )
    free = nearest(downloads, executions.where("free"), tiled)
    best = F.min(F.struct(F.col("idx").alias("idx1"), F.col("line").alias("line1"), "idx2", "line2"))
    return by_word.unionByName(free).groupBy(*keys).agg(best.alias("m")).select(*keys, "m.*")


def _derived(first: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, object, ready): the smallest, over an object's derivations, of the largest step index they use.

    Each round hands on only what the last one improved, so the rounds follow the hops of the longest
    derivation that matters, and a document spreads over tasks by its objects.
    """
    at = [*keys, "object"]
    parts = news = first
    while True:
        known = parts.groupBy(*at).agg(F.min("ready").alias("known"))
        heard = news.join(edges, at).groupBy(*keys, F.col("output").alias("object")).agg(F.min(F.greatest("ready", "step")).alias("ready"))
        news = cut(heard.join(known, at, "left").where("known IS NULL OR ready < known").select(*at, "ready"))
        if news.isEmpty():
            return known.withColumnRenamed("known", "ready")
        parts = parts.unionByName(news)


def _sources(sinks: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, object, sink_idx): what the object of each sink stems from by steps before it, itself included."""
    at = [*keys, "object"]
    seen = news = sinks.select(*at, "sink_idx")
    while True:
        before = edges.join(news.withColumnRenamed("object", "output"), [*keys, "output"]).where("step < sink_idx").select(*at, "sink_idx").distinct()
        news = cut(before.join(seen, at, "left_anti"))
        if news.isEmpty():
            return seen
        seen = seen.unionByName(news)


@by_target()
def find_source_sink(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First network action per group whose object stems from an earlier source.

    Returns object, sink idx and line, and the line of the earliest producer. An object is ready when a
    source names it, or when a transformation makes it of one that is ready; the sink must come later.
    """
    at = [*keys, "object"]
    named = steps.where("object <> '' AND category IN ('SOURCE', 'SENSITIVE', 'TRANSFORM', 'NETWORK')").select(
        *keys, F.col("idx").cast("long").alias("idx"), F.col("line").cast("int").alias("line"), "category", "object", "destination", "output"
    )
    named = cut(named.where("(category <> 'TRANSFORM' OR output <> '') AND (category <> 'NETWORK' OR destination IS NOT NULL)"))
    made = named.where("category IN ('SOURCE', 'SENSITIVE')").groupBy(*at).agg(F.min(F.struct("idx", "line")).alias("f"))
    first = made.select(*at, F.col("f.idx").alias("ready"), F.col("f.line").alias("made_line"))
    edges = named.where("category = 'TRANSFORM'").groupBy(*at, "output").agg(F.min("idx").alias("step"))
    ready = _derived(first.select(*at, "ready"), edges, keys)
    sent = named.where("category = 'NETWORK'").select(*at, "idx", "line").join(ready, at).where("ready < idx")
    best = sent.groupBy(*keys).agg(F.min(F.struct("idx", "line", "object")).alias("b"))
    sinks = cut(best.select(*keys, F.col("b.object").alias("object"), F.col("b.idx").alias("sink_idx"), F.col("b.line").alias("last_line")))
    settle(steps.sparkSession)
    origin = _sources(sinks, edges, keys).join(first, at).where("ready < sink_idx").groupBy(*keys).agg(F.min("made_line").alias("first_line"))
    return sinks.join(origin, list(keys)).select(*keys, "object", "sink_idx", "last_line", "first_line")


@by_target()
def file_chains(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chain findings of single documents: rule, severity, title, evidence, first and last line.

    ``steps`` is read three times and should be written down.
    """
    steps = steps.select(*keys, *ACTION_COLUMNS)
    exfil = cut(find_sequence(steps, keys, ["SOURCE", "SENSITIVE", "NETWORK"]))
    fetch = cut(find_download_execute(steps, keys))
    settle(steps.sparkSession)
    sink = cut(find_source_sink(steps, keys))
    base = [F.col(k) for k in keys]

    def row(df: DataFrame, rule: str, title: str, description: str, evidence: Column, first: str, last: str) -> DataFrame:
        return df.select(
            *base,
            F.lit(rule).alias("rule_id"), F.lit("CRITICAL").alias("severity"), F.lit(title).alias("title"),
            F.lit(description).alias("description"), evidence.alias("evidence"),
            F.col(first).alias("first"), F.col(last).alias("last"),
        )

    return (
        row(exfil, "AS-CHAIN-001", "Potential secret exfiltration chain",
            "Steps of this file read sensitive data, extract a secret and send it out.",
            F.lit(evidence_of(["SOURCE", "SENSITIVE", "NETWORK"])), "line1", "line3")
        .unionByName(row(fetch, "AS-CHAIN-002", "Remote download followed by execution",
                         "Steps of this file fetch remote content and then run it.",
                         F.lit(evidence_of(["DOWNLOAD", "EXECUTION"])), "line1", "line2"))
        .unionByName(row(sink, "AS-CHAIN-004", "Potential data exfiltration chain (source-to-sink)",
                         "What this file reads or extracts is sent to an external destination.",
                         F.concat(F.lit("Source-to-sink: "), "object", F.lit(" -> external destination")),
                         "first_line", "last_line"))
    )
