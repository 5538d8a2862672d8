"""String and array expressions used by several stages. Everything stays a Column."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight import vocab

# fixed value: the line terminators a text reader honours
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1c\x1d\x1e\x85\u2028\u2029]"
# A pattern means the same for every script only with Unicode classes.
UNICODE = "(?U)"
UNICODE_FOLD = "(?iU)"


def has(text: Column, pattern: str, fold: bool = False) -> Column:
    return text.rlike((UNICODE_FOLD if fold else UNICODE) + pattern)


def find_all(text: Column, pattern: str, group: int = 0, fold: bool = False) -> Column:
    return F.regexp_extract_all(
        text, F.lit((UNICODE_FOLD if fold else UNICODE) + pattern), F.lit(group)
    )


def first_match(text: Column, pattern: str, group: int = 0, fold: bool = False) -> Column:
    return F.regexp_extract(text, (UNICODE_FOLD if fold else UNICODE) + pattern, group)


def position(text: Column, pattern: str, fold: bool = False) -> Column:
    """1-based start of the first match, 0 when there is none."""
    return F.regexp_instr(text, F.lit((UNICODE_FOLD if fold else UNICODE) + pattern))


def replace(text: Column, pattern: str, by: str, fold: bool = False) -> Column:
    return F.regexp_replace(text, (UNICODE_FOLD if fold else UNICODE) + pattern, by)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def before(text: Column, start: Column) -> Column:
    """The part left of a 1-based position."""
    return F.substring(text, F.lit(1), start - 1)


def split_lines(text: Column, pattern: str = LINE_BREAK) -> Column:
    """Lines of a non-empty text; a final terminator opens no further line."""
    body = F.when(
        F.right(text, F.lit(1)).rlike(pattern), F.regexp_replace(text, f"(?:{pattern})\\z", "")
    ).otherwise(text)
    return F.split(body, pattern, -1)


def last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def any_contains(text: Column, needles: Sequence[str]) -> Column:
    """True when one of a few fixed substrings occurs (a byte search, no regex)."""
    result = text.contains(needles[0])
    for needle in needles[1:]:
        result = result | text.contains(needle)
    return result


def any_word(words: Sequence[str]) -> str:
    """A pattern for ``matching``: one of a few fixed substrings occurs."""
    return "|".join(re.escape(w) for w in words)


def matching(text: Column, choices: Sequence[Sequence[str]]) -> Column:
    """A long whose bit k is set where ``text`` matches every pattern of the k-th choice (62 at most); 0 for null.

    A sieve in front of searches that are exact: however many words the patterns name, Arrow's automaton reads
    a batch of texts once, and what matches no choice's first pattern is not looked at again.
    """
    if not 0 < len(choices) <= 62:
        raise ValueError("between 1 and 62 choices")
    sieve = "|".join(f"(?:{choice[0]})" for choice in choices)

    @F.arrow_udf("long")
    def bits(texts: pa.Array) -> pa.Array:
        def rows(some: pa.Array, pattern: str) -> np.ndarray:
            return np.flatnonzero(pc.fill_null(pc.match_substring_regex(some, pattern), False).to_numpy(zero_copy_only=False))

        found = np.zeros(len(texts), np.int64)
        able = rows(texts, sieve)
        some = texts.take(pa.array(able))
        for k, choice in enumerate(choices):
            at, left = able, some
            for pattern in choice:
                if not len(at):
                    break
                hit = rows(left, pattern)
                at, left = at[hit], left.take(pa.array(hit)) if len(choice) > 1 else left
            found[at] |= 1 << k
        return pa.array(found)

    return F.coalesce(bits(text), F.lit(0))


#: Letters (long s, dotless i, a dot set on an i) that only patterns fold to ASCII ones.
FOLDED = ["\u017f", "\u0131", "\u0307"]


def folds_to_ascii(low: Column) -> Column:
    """Lower-case text with letters that only patterns fold to ASCII ones."""
    return any_contains(low, FOLDED)


def once(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with ``value`` computed once per row, however often and wherever it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def clean_set(values: Column) -> Column:
    """Trim, drop blanks, remove duplicates, sort."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), strip)
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & (v != ""))))


def map_lookup(key: Column, table: dict, default=None) -> Column:
    """A constant dictionary as a CASE expression."""
    expr = None
    for k, v in table.items():
        cond = key == k
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    return map_lookup(severity, vocab.SEVERITY_RANK)


def severity_name(rank: Column) -> Column:
    return map_lookup(rank, {v: k for k, v in vocab.SEVERITY_RANK.items()})


def confidence_rank(confidence: Column) -> Column:
    return map_lookup(confidence, vocab.CONFIDENCE_RANK)


def confidence_name(rank: Column) -> Column:
    return map_lookup(rank, {v: k for k, v in vocab.CONFIDENCE_RANK.items()})


def escape_untrusted(text: Column, limit: int | None = vocab.MAX_TEXT_CHARS) -> Column:
    """Make every non-printable character visible and bound the result.

    Only texts that need it are taken apart; clean text passes untouched.
    """
    unprintable = r"[\p{C}\p{Z}&&[^ ]]"

    def visible(ch: Column) -> Column:
        code = F.lower(F.hex(F.encode(ch, "UTF-32")))
        return (
            F.when(ch == "\\", F.lit("\\\\"))
            .when(~ch.rlike(unprintable), ch)
            .when(code.startswith("000000"), F.concat(F.lit("\\x"), F.right(code, F.lit(2))))
            .when(code.startswith("0000"), F.concat(F.lit("\\u"), F.right(code, F.lit(4))))
            .otherwise(F.concat(F.lit("\\U"), code))
        )

    shown = F.when(
        text.rlike(unprintable) | text.contains("\\"),
        F.array_join(F.transform(F.split(text, ""), visible), ""),
    ).otherwise(text)
    if limit is None:
        return shown
    return F.when(
        F.length(shown) > limit,
        F.concat(F.left(shown, F.lit(limit)), F.lit(vocab.TRUNCATION_MARKER)),
    ).otherwise(shown)


def url_host(text: Column) -> Column:
    """Lower-case host (and port) of the first URL, null when there is none."""
    host = F.lower(F.regexp_extract(text, r"https?://([^/\s'\"]+)", 1))
    return F.nullif(host, F.lit(""))


def strip_url_tail(url: Column) -> Column:
    """Drop sentence punctuation behind a URL."""
    return F.rtrim(url, F.lit(".,;:!?)]}\"'"))
