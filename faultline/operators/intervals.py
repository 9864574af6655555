"""Joins of intervals of any widths. An interval is filed in the blocks of its own level, the least power of two that holds its
width, and, where the other side has wider ones, in theirs: two blocks a level at most. Two intervals that overlap meet at the
wider one's level, in the block where the later one begins, and nowhere else; a key with many intervals spreads over its blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _level(lo, hi):
    """The least n with 2 ** n > hi - lo."""
    return F.when(hi == lo, 0).otherwise(F.length(F.bin(hi - lo))).cast("int")


def _filed(rows: DataFrame, lo: str, hi: str, others: list[int], name: str) -> DataFrame:
    own = _level(F.col(lo).cast("long"), F.col(hi).cast("long"))
    level = F.explode(F.array_distinct(F.concat(F.array(own), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > own)))).alias("_level")
    at = rows.select("*", own.alias(f"_{name}"), level)
    return at.withColumn("_block", F.explode(F.expr(f"sequence(shiftright(CAST({lo} AS BIGINT), _level), shiftright(CAST({hi} AS BIGINT), _level))")))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of left and right with equal keys whose spans (first and last, whole numbers, both inside) share a number; how:
    inner, or left_semi for the rows of left that have a partner. Spans with a null, or that end before they begin, meet none.
    Columns of the two sides, but for the keys, must differ in their names."""
    (a, b), (c, d) = left_span, right_span
    left_rows, right_rows = left.filter(f"{a} <= {b}"), right.filter(f"{c} <= {d}")
    levels = lambda rows, lo, hi: sorted(r[0] for r in rows.select(_level(F.col(lo).cast("long"), F.col(hi).cast("long"))).distinct().collect())  # noqa: E731  64 at most
    x, y = _filed(left_rows, a, b, levels(right_rows, c, d), "l"), _filed(right_rows, c, d, levels(left_rows, a, b), "r")
    y = y.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in y.columns if k not in ("_level", "_block")], F.col("_level").alias("_r_level"), F.col("_block").alias("_r_block"))
    same = (F.col("_level") == F.col("_r_level")) & (F.col("_block") == F.col("_r_block"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    first = F.expr(f"shiftright(CAST(greatest({a}, {c}) AS BIGINT), _level)")
    meet = same & (F.col("_level") == F.greatest("_l", "_r")) & (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (first == F.col("_block"))
    if how == "left_semi":
        return x.join(y, meet, "left_semi").drop("_l", "_level", "_block").distinct()
    return x.join(y, meet).drop("_l", "_r", "_level", "_block", "_r_level", "_r_block", *[f"_k_{k}" for k in keys])
