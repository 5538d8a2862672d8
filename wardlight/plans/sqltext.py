"""Small builders for the DuckDB twins: the same meaning, said in SQL."""

from __future__ import annotations

from wardlight.operators import rule_catalog as rc


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def plain_regex(pattern: str) -> str:
    """Possessive quantifiers only save time; DuckDB's engine never backtracks."""
    return pattern.replace("*+", "*").replace("++", "+")


def m(column: str, pattern: str, fold: bool = False) -> str:
    return f"regexp_matches({column}, {q(('(?i)' if fold else '') + plain_regex(pattern))})"


def every(column: str, pattern: str, group: int = 0, fold: bool = False) -> str:
    return f"regexp_extract_all({column}, {q(('(?i)' if fold else '') + plain_regex(pattern))}, {group})"


def lead(column: str, pattern: str) -> str:
    """Text before the first match."""
    return f"regexp_extract({column}, {q('(?is)^(.*?)(?:' + pattern + ')')}, 1)"


def tail(column: str, pattern: str) -> str:
    """Text behind the first match."""
    return f"regexp_extract({column}, {q('(?is)^.*?(?:' + pattern + ')(.*)$')}, 1)"


def count_of(column: str, ch: str) -> str:
    return f"(length({column}) - length(replace({column}, {q(ch)}, '')))"


def left_of_last(column: str, ch: str) -> str:
    return f"regexp_extract({column}, {q('(?s)^(.*)' + ch)}, 1)"


def inside_pair(ch: str) -> str:
    cond = f"({count_of('pre', ch)} % 2 = 1 AND contains(suf, {q(ch)})"
    if ch == "'":
        left = left_of_last("pre", ch)
        after = f"regexp_extract(suf, {q(chr(94) + chr(91) + chr(94) + ch + ']*' + ch + '(.)')}, 1)"
        cond += f" AND NOT ({m(left, '[\\p{L}\\p{N}]$')} AND {m(after, '^[\\p{L}\\p{N}]')})"
    return cond + ")"


def quoted_mention() -> str:
    cases = f"WHEN contains(pre, '“') AND contains(suf, '”') THEN {left_of_last('pre', chr(0x201C))}"
    for ch in ('"', "'", "`"):
        cases += f" WHEN {inside_pair(ch)} THEN {left_of_last('pre', ch)}"
    return f"coalesce({m(f'(CASE {cases} END)', rc.DEFENSIVE_FRAME, fold=True)}, false)"


def vocabulary_row() -> str:
    apostrophes = (
        "len(list_filter(range(0, (len(string_split(text, '''')) - 1) // 2), lambda k: NOT ("
        + m("string_split(text, '''')[2 * k + 1]", r"[\p{L}\p{N}]$")
        + " AND "
        + m("string_split(text, '''')[2 * k + 3]", r"^[\p{L}\p{N}]")
        + ")))"
    )
    total = f"({count_of('text', chr(34))} // 2 + {count_of('text', '`')} // 2 + {apostrophes})"
    inside = " OR ".join(inside_pair(ch) for ch in ('"', "'", "`"))
    return f"({total} >= 3 AND ({inside}))"


MASKED = (
    "CASE WHEN regexp_matches(text, '`.*`') THEN regexp_extract(text, '^([^`]*)`', 1) || "
    "regexp_replace(regexp_extract(text, '^[^`]*(`.*`)[^`]*$', 1), '[^\"]', '`', 'g') || "
    "regexp_extract(text, '`([^`]*)$', 1) ELSE text END"
)


def live(pattern: str, fold: bool = False, masked: str = MASKED) -> str:
    tokens = f"regexp_extract_all({masked}, {q(('(?i)' if fold else '') + chr(34) + '[^' + chr(34) + ']*' + chr(34) + '|(?:' + plain_regex(pattern) + ')')})"
    return f"list_filter({tokens}, lambda t: NOT starts_with(t, '\"'))"
