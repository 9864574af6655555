"""Graphs dealt over tasks, each whole in one: strongly connected parts and cycles of thousands of small graphs at once in arrays, one
shuffle in place of one a round. Graphs of more than whole.MOST nodes, and all graphs where an edge leaves its graph, go in rounds of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs, whole

#: Numbers in the ways that are drawn out at once.
DRAWN = 1 << 18


def _edges(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("node").alias("src"), F.explode("next").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")


def _dealt(adjacent: DataFrame, graph: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows (proc, node, next) of the graphs that go to tasks, and of those that go in rounds. graph: SQL of the number of a node's graph, with {0} for the node."""
    rows = adjacent.filter("node IS NOT NULL").select(F.expr(graph.format("node")).cast("bigint").alias("proc"), F.col("node").cast("bigint").alias("node"), F.col("next").cast("array<bigint>").alias("next"))
    if not rows.filter(F.expr(f"exists(next, x -> x IS NOT NULL AND {graph.format('x')} <> proc)")).isEmpty():
        return None, rows
    small, large = whole.dealt(rows)
    return small, None if large is None else rows.join(large, "proc", "left_semi")


def strong_components(adjacent: DataFrame, graph: str) -> DataFrame:
    """(node, component): the largest node of the strongly connected part of each node of adjacent (node, next), next being an array of nodes."""
    small, large = _dealt(adjacent, graph)
    found = None if small is None else small.mapInArrow(whole.by_procedures(_parts), "node bigint, component bigint")
    if large is None:
        return found
    own = large.select("node").distinct()
    others = own.join(graphs.strong_components(_edges(large)), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return others if found is None else found.unionByName(others)


def cycles(adjacent: DataFrame, graph: str) -> DataFrame:
    """(path): every cycle of adjacent (node, next) that passes no node twice, once, from its least node on."""
    small, large = _dealt(adjacent, graph)
    found = None if small is None else small.mapInArrow(whole.by_procedures(_cycles), "path array<bigint>")
    if large is None:
        return found
    others = graphs.cycles(_edges(large))
    return others if found is None else found.unionByName(others)


def _numbered(table: pa.Table, proc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each node's graph and name, in order; the edges' ends as places among them, each edge once; and the nodes that have rows of their own."""
    node = table.column("node").to_numpy()
    lists = table.column("next").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    (dst, gone), of = whole.numbers(pa.chunked_array([lists.flatten()])), np.repeat(np.arange(len(node)), size)
    dst, of = dst[~gone], of[~gone]
    every, number = whole.coded(np.concatenate([proc, proc[of]]), np.concatenate([node, dst]))
    here, there = number[: len(node)], number[len(node) :]
    a, b = here[of], there
    once, _ = whole.coded(a, b)
    return np.concatenate([proc, proc[of]])[every], np.concatenate([node, dst])[every], a[once], b[once], np.unique(here)


def _reached(first: np.ndarray, base: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the nodes of its graph that it reaches over edges a to b, itself included, as bits: words[i] words from base[i] on."""
    place = np.arange(len(words)) - first
    state = np.zeros(int(words.sum()), np.uint64)
    state[base + (place >> 6)] = np.uint64(1) << (place & 63).astype(np.uint64)
    w, of = whole.spread(np.zeros(len(a), np.int64), words[a])
    to, src = base[a[of]] + w, base[b[of]] + w
    order = np.argsort(to, kind="stable")
    to, src = to[order], src[order]
    active = np.ones(len(state), bool)
    while len(go := np.flatnonzero(active[src])):
        begin = whole.runs(to[go])
        at = to[go][begin]
        came = np.bitwise_or.reduceat(state[src[go]], begin) & ~state[at]
        state[at] |= came
        active = np.zeros(len(state), bool)
        active[at[came != 0]] = True
    return state


def _components(graph: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of the last node of each node's strongly connected part."""
    begin = whole.runs(graph)
    size = np.diff(np.concatenate([begin, [len(graph)]]))
    first = np.repeat(begin, size)
    words = np.repeat((size + 63) >> 6, size)
    base = np.cumsum(words) - words
    both = _reached(first, base, words, a, b) & _reached(first, base, words, b, a)
    w, of = whole.spread(np.zeros(len(words), np.int64), words)
    filled = np.flatnonzero(both)
    last = filled[np.concatenate([of[filled][1:] != of[filled][:-1], [True]])]
    bits, high = both[last].copy(), np.zeros(len(last), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        more = bits >> np.uint64(step) != 0
        high[more] += step
        bits[more] >>= np.uint64(step)
    return first + 64 * w[last] + high


def _parts(table: pa.Table, proc: np.ndarray) -> Iterator[pa.RecordBatch]:
    graph, name, a, b, own = _numbered(table, proc)
    part = _components(graph, a, b)
    yield pa.RecordBatch.from_arrays([pa.array(name[own]), pa.array(name[part[own]])], ["node", "component"])


def _cycles(table: pa.Table, proc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ways from each node over larger ones of its part; what is drawn out last is drawn on first, so few ways are held."""
    graph, name, a, b, _ = _numbered(table, proc)
    part = _components(graph, a, b)
    inside = part[a] == part[b]
    a, b = a[inside], b[inside]
    out = np.bincount(a, minlength=len(name))
    first = np.cumsum(out) - out
    held = [np.flatnonzero(out).astype(np.int32)[:, None]]
    while held:
        ways = held.pop()
        at_once = max(1, DRAWN // ways.shape[1])
        if len(ways) > at_once:
            held.append(ways[at_once:])
            ways = ways[:at_once]
        edge, of = whole.spread(first[ways[:, -1]], out[ways[:, -1]])
        to, start = b[edge], ways[of, 0]
        closed = ways[of[to == start]]
        if len(closed):
            offsets = np.arange(len(closed) + 1, dtype=np.int32) * closed.shape[1]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(name[closed.ravel()]))], ["path"])
        on = np.flatnonzero(to > start)
        on = on[(ways[of[on]] != to[on, None]).all(axis=1)]
        if len(on):
            held.append(np.concatenate([ways[of[on]], to[on, None].astype(np.int32)], axis=1))
