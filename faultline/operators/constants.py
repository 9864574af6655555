"""Constants along branches that can be taken: values of variables at nodes and open edges, found together to a fixpoint.

A variable at a node that can be reached has one value or many. An edge is open when its node is reached and the folded condition,
if it has one, comes out as the edge's label or is not known. Values flow over open edges only, so what a dead branch assigns
counts for nothing. A round takes the nodes where something changed, and a value changes at most once, from one to many.
Procedures of a bounded size go to tasks, where the same rounds run over the values of thousands of them as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import whole
from .fixpoint import _cut, _drop

AT = ["proc", "node", "var"]
#: A variable of no program, which is there wherever a node is reached.
HERE = -1


def _one_or_many():
    """The value if there is one; null if any is null or two differ."""
    return F.when((F.count("value") == F.count("*")) & (F.min("value") == F.max("value")), F.min("value")).alias("value")


def _settled(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*AT).agg(_one_or_many())


def _open(edges: DataFrame, tests: DataFrame, values: DataFrame) -> DataFrame:
    """The open edges of the nodes that have values."""
    here = values.select("proc", F.col("node").alias("src"), F.col("var"), "value")
    reached = here.filter(F.col("var") == HERE).select("proc", "src")
    tested = edges.join(reached, ["proc", "src"]).join(tests, ["proc", "src"], "left").join(here, ["proc", "src", "var"], "left")
    taken = F.when(F.col("value") >= F.col("least"), "true").otherwise("false")
    return tested.filter(F.col("value").isNull() | (F.col("label") == taken)).select("proc", "src", "dst", "label")


def constants(edges: DataFrame, starts: DataFrame, statements: DataFrame, tests: DataFrame, at_start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values (proc, node, var, value) where reached nodes begin, null for many; and open edges (proc, src, dst, label).

    edges: (proc, src, dst, label). starts: (proc, node). statements: (proc, node, var, left, right, plus): var becomes the sum of
    the variables left and right (null: none) and the number plus, or anything where plus is null. tests: (proc, node, var, least):
    the node's edges are labelled "true" and "false", and var >= least takes the true one. at_start: (proc, node, var, value) at
    starts; a variable without a row there, like one with null, may be anything. A node sets and tests one variable at most;
    variables are integers of 0 and above. A sum beyond a long is anything."""
    both = _cut(solved(edges, starts, statements, tests, at_start))
    return both.filter("node IS NOT NULL").select(*AT, "value"), both.filter("src IS NOT NULL").select("proc", "src", "dst", "label")


#: What the rows of edges, starts, statements, tests and at_start hold as one table.
COLUMNS = {"node": "bigint", "dst": "bigint", "label": "string", "var": "bigint", "left": "bigint", "right": "bigint", "value": "bigint"}
EDGE, START, SET, TEST, AT_START = range(5)
NONE, ONE, MANY = range(3)


def solved(edges: DataFrame, starts: DataFrame, statements: DataFrame, tests: DataFrame, at_start: DataFrame) -> DataFrame:
    """Values and open edges as one table: (proc, node, var, value) and nulls, or (proc, src, dst, label) and nulls."""
    tables = [edges, starts, statements, tests, at_start]
    together = lambda given: (lambda values, opened: values.unionByName(opened, allowMissingColumns=True))(*_in_rounds(*given))
    if not whole.are_numbers(tables, ("node", "src", "dst")):
        return together(tables)
    source = [edges.withColumnRenamed("src", "node"), starts, statements.withColumnRenamed("plus", "value"), tests.withColumnRenamed("least", "value"), at_start]
    small, large = whole.dealt(whole.one_table(source, COLUMNS))
    kinds = lambda *names: whole.widest(*[k for t in tables for c, k in t.dtypes if c in names])
    proc = edges.schema["proc"].dataType.simpleString()
    found = small.mapInArrow(whole.by_procedures(_solve), f"proc {proc}, node bigint, var int, value bigint, src bigint, dst bigint, label string")
    at = lambda c, *of: F.col(c).cast(kinds(*of)).alias(c)
    found = found.select("proc", at("node", "node", "dst"), "var", "value", at("src", "src"), at("dst", "dst"), "label")
    if large is None:
        return found
    return found.unionByName(together([t.join(large, "proc", "left_semi") for t in tables]))


def _sum(a: np.ndarray, many_a: np.ndarray, b: np.ndarray, many_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum, and whether it may be anything: as one of its terms, or beyond a long."""
    with np.errstate(over="ignore"):
        s = a + b
    return s, many_a | many_b | (((a ^ s) & (b ^ s)) < 0)


def _solve(table: pa.Table, proc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rounds of some whole procedures: a cell is a variable at a node; what comes to it, comes over an edge from the same variable or from a statement."""
    kind, (label, labels) = table.column("kind").to_numpy(), whole.texts(table.column("label"))
    (node, no_node), (dst, no_dst), (var, no_var), (left, no_left), (right, no_right), (value, no_value) = (whole.numbers(table.column(c)) for c in ("node", "dst", "var", "left", "right", "value"))
    names, procs = table.column("proc").take(pa.array(whole.runs(proc))), int(proc[-1]) + 1
    use = ~(no_node | ((kind == EDGE) & no_dst) | ((kind >= SET) & no_var))
    kind, proc, node, dst, label, var, left, no_left, right, no_right, value, no_value = (x[use] for x in (kind, proc, node, dst, label, var, left, no_left, right, no_right, value, no_value))
    e, start, sets, test, given = (np.flatnonzero(kind == k) for k in (EDGE, START, SET, TEST, AT_START))
    e = e[whole.coded(proc[e], node[e], dst[e], label[e])[0]]
    # nodes and variables of a procedure, numbered
    at, number = whole.coded(np.concatenate([proc, proc[e]]), np.concatenate([node, dst[e]]))
    of_node, id_node = np.concatenate([proc, proc[e]])[at], np.concatenate([node, dst[e]])[at]
    here, e_src, e_dst = number[: len(proc)], number[e], number[len(proc) :]
    of_set = sets[~no_left[sets]], sets[~no_right[sets]]
    spoken = np.concatenate([sets, test, *of_set, given])
    v_of, v_var = proc[spoken], np.concatenate([var[sets], var[test], left[of_set[0]], right[of_set[1]], var[given]])
    at, v_number = whole.coded(v_of, v_var)
    v_of, v_var = v_of[at], v_var[at]
    v_size = np.bincount(v_of, minlength=procs)
    v_first = np.cumsum(v_size) - v_size
    ends = np.cumsum([len(x) for x in (sets, test, *of_set, given)])
    set_var, test_var, left_var, right_var, given_var = np.split(v_number, ends[:-1])
    size = v_size[of_node]
    base = np.cumsum(size) - size
    cell = lambda nodes, v: base[nodes] + v - v_first[of_node[nodes]]
    tag, held = np.zeros(int(size.sum()), np.int8), np.zeros(int(size.sum()), np.int64)
    # what holds at starts: all that is named and not given may be anything
    begins = np.zeros(len(of_node), bool)
    begins[here[start]] = True
    named = np.zeros(len(v_of), bool)
    named[np.concatenate([set_var, test_var, left_var, right_var])] = True
    v, of = whole.spread(v_first[of_node], size)
    first = np.flatnonzero(begins[of] & named[v])
    ok = begins[here[given]]
    given, given_var = given[ok], given_var[ok]
    given_cell = cell(here[given], given_var)
    tag[np.setdiff1d(first, given_cell)] = MANY
    order = np.argsort(given_cell, kind="stable")
    run = whole.runs(given_cell[order])
    if len(run):
        g = given[order]
        low, high, unknown = np.minimum.reduceat(value[g], run), np.maximum.reduceat(value[g], run), np.maximum.reduceat(no_value[g], run)
        to = given_cell[order][run]
        tag[to], held[to] = np.where(unknown | (low != high), MANY, ONE), low
    # statements, and the tests of an edge's node
    set_node, set_to = here[sets], set_var
    set_cell = cell(set_node, set_var)
    left_cell, right_cell = np.full(len(sets), -1), np.full(len(sets), -1)
    left_cell[~no_left[sets]], right_cell[~no_right[sets]] = cell(here[of_set[0]], left_var), cell(here[of_set[1]], right_var)
    is_set = np.zeros(len(tag), bool)
    is_set[set_cell] = True
    t_order = np.argsort(here[test], kind="stable")
    t_node, t_cell = here[test][t_order], cell(here[test], test_var)[t_order]
    t_least, t_none = value[test][t_order], no_value[test][t_order]
    t_first = np.searchsorted(t_node, e_src)
    t_size = np.searchsorted(t_node, e_src, "right") - t_first
    t_of, te = whole.spread(t_first, t_size)
    coded = {text: i for i, text in enumerate(labels)}
    true, false = coded.get("true", -1), coded.get("false", -1)
    e_label = label[e]
    # links: over an edge from a cell that its node does not set, and over an edge from a statement
    kv, ke = whole.spread(base[e_src], size[e_src])
    ok = ~is_set[kv]
    kv, ke = kv[ok], ke[ok]
    k_to = kv - base[e_src[ke]] + base[e_dst[ke]]
    s_order = np.argsort(set_node, kind="stable")
    s_first = np.searchsorted(set_node[s_order], e_src)
    s_size = np.searchsorted(set_node[s_order], e_src, "right") - s_first
    sv, se = whole.spread(s_first, s_size)
    sv = s_order[sv]
    s_to = cell(e_dst[se], set_to[sv])
    to, over, of_kept, of_stmt = np.concatenate([k_to, s_to]), np.concatenate([ke, se]), np.concatenate([kv, np.full(len(sv), -1)]), np.concatenate([np.full(len(kv), -1), sv])
    order = np.argsort(to, kind="stable")
    to, over, of_kept, of_stmt = to[order], over[order], of_kept[order], of_stmt[order]
    reached, active = begins.copy(), begins.copy()

    def opened() -> np.ndarray:
        """Which edges are open, as far as is known."""
        t = tag[t_cell[t_of]] != ONE
        is_true = ~t_none[t_of] & (held[t_cell[t_of]] >= t_least[t_of])
        passes = np.zeros(len(e), bool)
        passes[te[t | (e_label[te] == np.where(is_true, true, false))]] = True
        return reached[e_src] & (passes | (t_size == 0))

    def side(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(cells < 0, 0, held[cells]) if len(tag) else np.zeros(len(cells), np.int64), (cells >= 0) & (tag[cells] != ONE) if len(tag) else np.zeros(len(cells), bool)

    while active.any():
        go_edge = opened() & active[e_src]
        new = np.zeros(len(of_node), bool)
        new[e_dst[go_edge]] = True
        new &= ~reached
        reached |= new
        made, anything = _sum(*_sum(value[sets], no_value[sets], *side(left_cell)), *side(right_cell)) if len(sets) else (np.zeros(0, np.int64), np.zeros(0, bool))
        go = np.flatnonzero(go_edge[over])
        kept = of_kept[go] >= 0
        came, what = np.zeros(len(go), np.int8), np.zeros(len(go), np.int64)
        came[kept], what[kept] = tag[of_kept[go[kept]]], held[of_kept[go[kept]]]
        came[~kept], what[~kept] = np.where(anything[of_stmt[go[~kept]]], MANY, ONE), made[of_stmt[go[~kept]]]
        go, what, came = go[came > 0], what[came > 0], came[came > 0]
        active = new
        if len(go):
            run = whole.runs(to[go])
            at = to[go][run]
            most, low, high = (f.reduceat(x, run) for f, x in ((np.maximum, came), (np.minimum, what), (np.maximum, what)))
            now = np.where((most == MANY) | (low != high), MANY, ONE)
            then = np.where(tag[at] == NONE, now, np.where((now == MANY) | (low != held[at]), MANY, ONE))
            then = np.where(tag[at] == MANY, MANY, then)
            changed = then != tag[at]
            held[at] = np.where(tag[at] == NONE, low, held[at])
            tag[at] = then
            active[of[at[changed]]] = True
    shown = np.flatnonzero(tag > 0)
    empty = lambda n, kind: pa.nulls(n, kind)
    proc_of = lambda p: names.take(pa.array(p)).combine_chunks()
    columns = ["proc", "node", "var", "value", "src", "dst", "label"]
    n = len(shown)
    yield pa.RecordBatch.from_arrays([proc_of(of_node[of[shown]]), pa.array(id_node[of[shown]]), pa.array(v_var[v[shown]].astype(np.int32)), pa.array(held[shown], mask=tag[shown] == MANY), empty(n, pa.int64()), empty(n, pa.int64()), empty(n, pa.string())], columns)
    go = np.flatnonzero(opened())
    n = len(go)
    yield pa.RecordBatch.from_arrays([proc_of(of_node[e_src[go]]), empty(n, pa.int64()), empty(n, pa.int32()), empty(n, pa.int64()), pa.array(id_node[e_src[go]]), pa.array(id_node[e_dst[go]]), pa.array(labels, pa.string()).take(pa.array(e_label[go]))], columns)


def _in_rounds(edges: DataFrame, starts: DataFrame, statements: DataFrame, tests: DataFrame, at_start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same by joins, a round at a time, for procedures of any size."""
    edges = _cut(edges.select("proc", "src", "dst", "label").distinct())
    sets = _cut(statements.select("proc", F.col("node").alias("src"), F.col("var").cast("int").alias("var"), F.col("left").cast("int").alias("left"), F.col("right").cast("int").alias("right"), F.col("plus").cast("long").alias("plus")))
    tests = _cut(tests.select("proc", F.col("node").alias("src"), F.col("var").cast("int").alias("var"), "least"))
    named = sets.select("proc", "var").unionByName(sets.select("proc", F.col("left").alias("var"))).unionByName(sets.select("proc", F.col("right").alias("var"))).unionByName(tests.select("proc", "var"))
    first = starts.select("proc", "node").distinct()
    given = at_start.select("proc", "node", F.col("var").cast("int").alias("var"), F.col("value").cast("long").alias("value"))
    unknown = first.join(named.filter("var IS NOT NULL").distinct(), "proc").join(given, AT, "left_anti").select(*AT, F.lit(None).cast("long").alias("value"))
    here = first.select("proc", "node", F.lit(HERE).alias("var"), F.lit(0).cast("long").alias("value"))
    new = _cut(given.join(first, ["proc", "node"], "left_semi").unionByName(unknown).unionByName(here))
    parts = [new]
    while not new.isEmpty():
        now = _cut(_settled(parts).join(new.select("proc", "node").distinct(), ["proc", "node"], "left_semi"))
        at = now.select("proc", F.col("node").alias("src"), "var", "value")
        side = lambda c: at.select("proc", "src", F.col("var").alias(c), F.col("value").alias(f"{c}_value"))
        term = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(F.col(f"{c}_value"))
        due = sets.join(at.filter(F.col("var") == HERE).select("proc", "src"), ["proc", "src"]).join(side("left"), ["proc", "src", "left"], "left").join(side("right"), ["proc", "src", "right"], "left")
        made = due.select("proc", "src", "var", F.try_add(F.try_add("plus", term("left")), term("right")).alias("value"))
        kept = at.join(sets.select("proc", "src", "var"), ["proc", "src", "var"], "left_anti")
        came = kept.unionByName(made).join(_open(edges, tests, now), ["proc", "src"]).select("proc", F.col("dst").alias("node"), "var", "value").groupBy(*AT).agg(_one_or_many())
        had = _settled(parts).select(*AT, F.col("value").alias("had"), F.lit(True).alias("old"))
        changed = came.join(had, AT, "left").filter(F.col("old").isNull() | (F.col("had").isNotNull() & ~F.col("value").eqNullSafe(F.col("had"))))
        new = _cut(changed.select(*AT, F.when(F.col("old").isNull(), F.col("value")).alias("value")))
        _drop(now)
        parts.append(new)
        if len(parts) == 8:
            whole = _cut(_settled(parts))
            for p in parts[:-1]:
                _drop(p)
            parts = [whole]
    values = _cut(_settled(parts))
    return values.filter(F.col("var") != HERE), _open(edges, tests, values)
