"""Rules from outside: as expressions, as tables, as Python with an error account."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators import line_rules as lr
from wardlight.operators import rule_catalog as rc
from wardlight.session import constant_table, cut

# Letters on which lines and stems meet.
STEM_PIECE = 5
WORD = r"(?U)\w+"
# Stems looked for in every line, and passed words sent to every task; more take the next way.
FEW_STEMS = 64
FEW_WORDS = 200_000


@dataclass
class RuleBook:
    """The built-in rules plus registered ones.

    A line rule is a :class:`LineRule` with its catalog row (rule id, severity,
    title, evidence, description, remediation). A document rule takes the
    document table and returns findings.
    """

    line_rules: list[lr.LineRule] = field(default_factory=lambda: list(lr.RULES))
    wording: list[tuple] = field(default_factory=list)
    document_rules: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def register_line_rule(self, rule: lr.LineRule, wording: Sequence[str]) -> lr.LineRule:
        self.line_rules.append(rule)
        self.wording.append((rule.rule, *wording, len(rc.RULE_ORDER) + len(self.wording)))
        return rule

    def register_document_rule(self, rule: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        self.document_rules.append(rule)
        return rule

    def line_findings(self, lines: DataFrame) -> DataFrame:
        table = rc.rule_table(lines.sparkSession)
        if self.wording:
            table = table.unionByName(constant_table(lines.sparkSession, [*rc.COLUMNS, "rule_order"], self.wording))
        return lr.dress(lr.judge_lines(lines, self.line_rules), table)

    def document_findings(self, docs: DataFrame) -> list[DataFrame]:
        return [rule(docs) for rule in self.document_rules]


def match_pattern_table(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """Lines against rules kept as data: ``pattern_id``, ``stem``, ``pattern``; one row per line and id.

    ``stem`` is a lower-case text with a letter or digit that every match contains. A few
    stems are looked for in every line. Of many, the longest word of each lies within some word of
    the line: the distinct words of all lines meet the stems on the first letters, as they occur
    anywhere in the word, and lines meet the words that passed. Whole stem and pattern are tested
    on the whole line in every case. The answer does not depend on the number of patterns.

    Texts are never dealt out per word: passed words go to the tasks while they are few, and
    else words are dealt out with the hash of their line, which only proposes a line.
    """
    kept = lines.columns
    table = patterns.select("pattern_id", "stem", "pattern").distinct().withColumn("_run", _longest_word(F.col("stem")))
    table = cut(table)
    n_stems, shortest = table.agg(F.countDistinct("stem"), F.min(F.length("_run"))).first()
    if shortest == 0:
        raise ValueError("a stem holds no letter or digit")
    if not n_stems:
        return lines.withColumn("pattern_id", F.lit(None).cast("string")).where("false")
    if n_stems <= FEW_STEMS:
        met = F.broadcast(table.drop("_run"))
        return _tested(lines.withColumn("_low", F.lower("text")).join(met, F.col("_low").contains(F.col("stem"))), kept)
    met = cut(_met_words(lines, table))
    if met.count() <= FEW_WORDS:
        found = lines.select(*kept, F.explode(_words()).alias("_word")).withColumn("_word", F.xxhash64("_word"))
        return _tested(found.join(F.broadcast(met), "_word").withColumn("_low", F.lower("text")), kept)
    found = lines.select(F.xxhash64("text").alias("_text"), F.explode(_words()).alias("_word"))
    met = found.select("_text", F.xxhash64("_word").alias("_word")).join(met, "_word").drop("_word").distinct()
    return _tested(lines.withColumn("_text", F.xxhash64("text")).join(met, "_text").withColumn("_low", F.lower("text")), kept)


def _words():
    return F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))


def _met_words(lines: DataFrame, table: DataFrame) -> DataFrame:
    """Hashes of words of the lines (``_word``) with the rules whose longest word may lie within them.

    A piece of a word carries its hash, and the word itself only while it is short.
    """
    sizes = [r.n for r in table.select(F.least(F.length("_run"), F.lit(STEM_PIECE)).alias("n")).distinct().collect()]  # at most STEM_PIECE

    def cuts(n: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("_word") - (n - 1), F.lit(1))), lambda at: F.substring(F.col("_word"), at, F.lit(n)))

    pieces = F.array_distinct(F.concat(*[cuts(n) for n in sorted(sizes)]))
    short = F.when(F.length("_word") <= 64, F.col("_word")).alias("_short")
    return (
        lines.select(F.explode(_words()).alias("_word")).distinct()
        .select(F.xxhash64("_word").alias("_key"), short, F.explode(pieces).alias("_piece"))
        .join(table.withColumn("_piece", F.left("_run", F.lit(STEM_PIECE))), "_piece")
        .where(F.col("_short").isNull() | F.col("_short").contains(F.col("_run")))
        .select(F.col("_key").alias("_word"), "pattern_id", "stem", "pattern").distinct()
    )


def _tested(proposed: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Proposed lines, with ``_low``, that hold the whole stem and the pattern."""
    holds = F.col("_low").contains(F.col("stem")) & F.expr("text RLIKE concat('(?iU)', pattern)")
    return proposed.where(holds).select(*kept, "pattern_id").distinct()


def _longest_word(text):
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return F.coalesce(longest["w"], F.lit(""))


def python_rule(judge: Callable[[str], str | None]):
    """Wrap a Python rule, text -> evidence or None, as a batched column function.

    A text the rule fails on yields an error type instead of stopping the scan.
    """
    @F.pandas_udf("struct<evidence:string,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found, errors = [], []
        for text in texts:
            try:
                found.append(judge(text))
                errors.append(None)
            except Exception as exc:  # the loss is recorded, the scan goes on
                found.append(None)
                errors.append(type(exc).__name__)
        return pd.DataFrame({"evidence": found, "error": errors})

    return run


def apply_python_rule(lines: DataFrame, name: str, judge: Callable[[str], str | None]) -> DataFrame:
    """Lines one Python rule hits or fails on: ``evidence`` of a finding, or ``reason`` and ``error_type``.

    Findings and errors are one table, so the rule runs once per line; filter on ``reason``.
    """
    judged = lines.withColumn("_r", python_rule(judge)(F.col("text")))
    failed = F.col("_r.error").isNotNull()
    return judged.where(F.col("_r.evidence").isNotNull() | failed).select(
        *lines.columns, F.lit(name).alias("rule"), F.col("_r.evidence").alias("evidence"),
        F.when(failed, F.lit("line_rule_exception")).alias("reason"), F.col("_r.error").alias("error_type"),
    )
