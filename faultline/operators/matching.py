"""Greedy choice at scale: of proposals that want the same things, the best by rank goes first, as if they were taken one by one in
order. In each round a proposal that is the best at all that it wants is chosen, and all that want any of it leave; no proposal
that goes later in the order could have changed that, so the result is that of the ordered loop. A round is an aggregate and two
joins over things, never over a whole key, so a key with a third of all proposals spreads over tasks. Where things are wanted in one
order, rounds follow one another as the things of a key do; keys of at most LOOPED pairs are therefore passed by the loop itself, in
order, many keys a task, and only larger ones go in rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fixpoint import _cut, _drop


def greedy_disjoint(wants: DataFrame, rank: str = "rank", proposal: str = "proposal", thing: str = "thing") -> DataFrame:
    """(proposal): those that the ordered greedy loop takes. wants: a row for each thing that a proposal needs, with its rank, the
    same in all its rows: less goes first, equal ranks by proposal. Repeated rows count once; nulls in a column want nothing."""
    left = _cut(wants.select(F.col(proposal).alias("proposal"), F.struct(F.col(rank).alias("r"), F.col(proposal).alias("p")).alias("rank"), F.col(thing).alias("thing")).filter("proposal IS NOT NULL AND thing IS NOT NULL").distinct())
    chosen = None
    while not left.isEmpty():
        best = left.groupBy("thing").agg(F.min("rank").alias("best"))
        judged = _cut(left.join(best, "thing").select("proposal", "rank", "thing", (F.col("rank") == F.col("best")).alias("first")))
        taken = judged.groupBy("proposal").agg(F.bool_and("first").alias("all")).filter("all").select("proposal")
        now = _cut(judged.join(taken, "proposal", "left_semi").select("proposal", "thing"))
        chosen = now.select("proposal") if chosen is None else chosen.unionByName(now.select("proposal"))
        out = judged.select("proposal", "thing").join(now.select("thing"), "thing", "left_semi").select("proposal").distinct()
        rest = _cut(judged.join(out, "proposal", "left_anti").select("proposal", "rank", "thing"))
        _drop(judged)
        _drop(left)
        left = rest
    return left.select("proposal") if chosen is None else chosen.distinct()


#: Pairs of a key that one task may pass over; it holds only the numbers of what is taken.
LOOPED = 1_000_000


def _looped(pairs: DataFrame, keys: list[str], rank: list[str], left: str, right: str) -> DataFrame:
    """The ordered loop over the pairs of each key. Ends are numbered within their key, so that the loop compares numbers."""
    number = lambda c: F.dense_rank().over(Window.partitionBy(*keys).orderBy(c))
    at, columns = Window.partitionBy(*keys).orderBy(*rank, left, right), pairs.columns
    rows = pairs.withColumn("_left", number(left)).withColumn("_right", number(right)).withColumn("_first", F.row_number().over(at) == 1).sortWithinPartitions(*keys, *rank, left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, rights = set(), set()
        for batch in batches:
            taken = []
            for a, b, first in zip(*(batch.column(c).to_pylist() for c in ("_left", "_right", "_first")), strict=True):
                if first:
                    lefts, rights = set(), set()
                free = a not in lefts and b not in rights
                if free:
                    lefts.add(a)
                    rights.add(b)
                taken.append(free)
            yield batch.select(columns).filter(pa.array(taken, pa.bool_()))

    return rows.mapInArrow(run, pairs.schema)


def one_to_one(pairs: DataFrame, keys: list[str], rank: list[str], left: str = "left", right: str = "right") -> DataFrame:
    """The pairs (keys, left, right) that the greedy loop over each key takes, in order of rank, then left, then right; each left and each right at most once. left and right are of one type."""
    pairs = _cut(pairs.select(*keys, *rank, left, right).distinct())
    large = _cut(pairs.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > LOOPED).select(*[F.col(k).alias(f"_{k}") for k in keys]))
    if large.isEmpty():
        return _looped(pairs, keys, rank, left, right).select(*keys, left, right)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    few, many = (pairs.join(F.broadcast(large), same, how) for how in ("left_anti", "left_semi"))
    return _looped(few, keys, rank, left, right).select(*keys, left, right).unionByName(_in_rounds(many, keys, rank, left, right))


def _in_rounds(pairs: DataFrame, keys: list[str], rank: list[str], left: str, right: str) -> DataFrame:
    pair = F.struct(*keys, left, right)
    side = lambda c, tag: pairs.select(pair.alias("proposal"), F.struct(*rank, left, right).alias("rank"), F.struct(*keys, F.lit(tag).alias("side"), F.col(c).alias("at")).alias("thing"))
    return greedy_disjoint(side(left, 0).unionByName(side(right, 1))).select("proposal.*")
