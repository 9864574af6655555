"""Procedures dealt over tasks, each whole in one: what stays inside a procedure is found there, thousands of procedures at once in
arrays, so a fixpoint is one shuffle in place of one a round. Procedures of more than MOST rows are left to rounds of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import _cut

#: Rows of a procedure that goes to a task; larger ones go in rounds.
MOST = 2_000
#: Rows that are worked on at once, and that make a task.
AT_ONCE, A_TASK = 100_000, 500_000
WHOLE_NUMBERS = ("bigint", "int", "smallint", "tinyint")


def widest(*types: str) -> str:
    return next(t for t in WHOLE_NUMBERS if t in types)


def are_numbers(tables: list[DataFrame | None], columns: tuple[str, ...]) -> bool:
    """Whether all of these columns that the tables have hold whole numbers."""
    return all(kind in WHOLE_NUMBERS for t in tables if t is not None for name, kind in t.dtypes if name in columns)


def one_table(tables: list[DataFrame | None], columns: dict[str, str]) -> DataFrame:
    """All rows as one table (proc, kind, *columns), kind being the place in the list. Rows of no procedure are left out."""
    out = None
    for kind, t in enumerate(tables):
        if t is not None:
            rows = t.filter("proc IS NOT NULL").select("proc", F.lit(kind).cast("tinyint").alias("kind"), *[(F.col(c) if c in t.columns else F.lit(None)).cast(of).alias(c) for c, of in columns.items()])
            out = rows if out is None else out.unionByName(rows)
    return out


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of procedures of at most MOST rows, sorted by procedure and dealt over tasks by their number; and the larger procedures (proc), if there are any."""
    sizes = rows.groupBy("proc").count()
    counted = {r.large: r.n for r in sizes.groupBy((F.col("count") > MOST).alias("large")).agg(F.sum("count").alias("n")).collect()}
    large = _cut(sizes.filter(F.col("count") > MOST).select("proc")) if True in counted else None
    small = rows if large is None else rows.join(large, "proc", "left_anti")
    return small.repartition(max(1, -(-counted.get(False, 0) // A_TASK)), "proc").sortWithinPartitions("proc"), large


def _begins(proc: pa.Array) -> np.ndarray:
    """Where another procedure begins, in sorted rows."""
    same = pc.equal(proc.slice(1), proc.slice(0, len(proc) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], ~same.astype(bool)])


def by_procedures(solve: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]):
    """A mapInArrow function over sorted rows: solve(rows of some whole procedures, number of each row's procedure among them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < AT_ONCE:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            begins = _begins(table.column(0).combine_chunks())
            last = int(np.flatnonzero(begins)[-1])
            if last:
                yield from solve(table.slice(0, last), np.cumsum(begins[:last]) - 1)
            rest = table.slice(last)
            held, n = rest.to_batches(), rest.num_rows
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from solve(table, np.cumsum(_begins(table.column(0).combine_chunks())) - 1)

    return run


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values as longs (0 for null), and which are null."""
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(), column.is_null().to_numpy()


def texts(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Texts as places in a list of distinct ones, null being one of them."""
    coded = pc.dictionary_encode(column, null_encoding="encode").combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def coded(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, as the place of one row of each, and for each row the number of its distinct one."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first, first + 1, ... of each span, and which span each is of."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size), of


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
