"""Joins on nearness of line numbers, safe for a file that holds most rows.

Rows meet on (keys, tile) instead of on the keys alone, so one file spreads
over as many tasks as it has tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.session import by_merge

TILE = 256


def tile_of(line: Column, width: int) -> Column:
    return F.floor(line / width)


def with_halo(rows: DataFrame, span: int, width: int = TILE) -> DataFrame:
    """Copy rows so that each tile also holds the ``span`` lines behind it.

    Adds ``tile`` and ``core``; a row is core in its own tile only.
    """
    own = tile_of(F.col("line"), width)
    copies = F.array_compact(
        F.array(
            F.struct(own.alias("tile"), F.lit(True).alias("core")),
            F.when(F.col("line") - own * width < span, F.struct((own - 1).alias("tile"), F.lit(False).alias("core"))),
        )
    )
    return rows.select(*rows.columns, F.inline(copies))


def near(left: DataFrame, right: DataFrame, keys: Sequence[str], span: int, how: str = "inner") -> DataFrame:
    """Join rows of equal keys whose lines are at most ``span`` apart.

    ``right`` must be small per line (aggregate it first); its columns other
    than the keys need names of their own, the line is called ``other_line``.
    """
    width = max(span, 1)
    own = left.withColumn("_tile", tile_of(F.col("line"), width))
    around = right.select(
        *right.columns,
        F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: tile_of(F.col("other_line"), width) + o)).alias("_tile"),
    )
    pair = own.alias("l").join(
        by_merge(around.alias("r")),
        _equal([*keys, "_tile"]) & (F.abs(F.col("l.line") - F.col("r.other_line")) <= span),
        how,
    )
    if how in ("left_semi", "left_anti"):
        return pair.drop("_tile")
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return pair.select(*[F.col(f"l.{c}") for c in left.columns], *extra)


def touching(ranges: DataFrame, points: DataFrame, keys: Sequence[str], width: int, how: str = "left_semi") -> DataFrame:
    """Ranges (``first``..``last``) that do (semi) or do not (anti) hold a point ``other_line``."""
    tiles = F.sequence(tile_of(F.col("first"), width), tile_of(F.col("last"), width))
    rows = ranges.withColumn("_id", F.struct(*ranges.columns))
    spread = rows.select("_id", *keys, "first", "last", F.explode(tiles).alias("_tile"))
    marks = points.select(*keys, "other_line", tile_of(F.col("other_line"), width).alias("_tile")).distinct()
    hit = (
        spread.alias("l")
        .join(
            by_merge(marks.alias("r")),
            _equal([*keys, "_tile"]) & F.col("r.other_line").between(F.col("l.first"), F.col("l.last")),
            "left_semi",
        )
        .select("_id")
        .distinct()
    )
    return rows.join(by_merge(hit), "_id", how).drop("_id")


def _equal(columns: Sequence[str]) -> Column:
    cond = F.col(f"l.{columns[0]}") == F.col(f"r.{columns[0]}")
    for c in columns[1:]:
        cond &= F.col(f"l.{c}") == F.col(f"r.{c}")
    return cond
