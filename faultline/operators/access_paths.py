"""Taint of fields and elements: facts are (variable, access path), moved along assignments between access paths by joins.

A path is the selectors from a variable on, "a.b", or "" for the variable itself; a tainted path taints all below it. `x.p = y.q`
moves what lies at or below y.q to below x.p, and taints x.p whole if y.q lies below a tainted path. Assignments belong to strata:
what one stratum makes is there for itself and for later ones, as members that a constructor sets are there for methods, and those
are there for the destructor. Paths through recursive structures have no end, so selectors after the first DEEPEST stand for all
that lies below: a path is then tainted whole, never lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import whole
from .fixpoint import _cut

#: Selectors of a path that are told apart.
DEEPEST = 5


def below(path: str, prefix: str) -> str:
    """SQL: does the path lie at or below the prefix."""
    return f"({prefix} = '' OR {path} = {prefix} OR {path} LIKE {prefix} || '.%')"


def moved(path: str, source: str, target: str, deepest: int = DEEPEST) -> str:
    """SQL: where a path at or below source lies once it is assigned to target; target itself, if source lies below the path."""
    rest = f"CASE WHEN length({path}) > length({source}) THEN substr({path}, length({source}) + CASE WHEN {source} = '' THEN 1 ELSE 2 END) ELSE '' END"
    whole = f"({target} || CASE WHEN {target} <> '' AND ({rest}) <> '' THEN '.' ELSE '' END || ({rest}))"
    kept = "RXONE(" + whole + f", '^([^.]*([.][^.]*){{0,{deepest - 1}}})')"
    return f"CASE WHEN {below(path, source)} THEN {kept} ELSE {target} END"


def _moved(path: str, source: str, target: str, deepest: int) -> str | None:
    """moved() of a path that lies at, below or above source; None of another."""
    if not source or path == source or path.startswith(source + "."):
        rest = path[len(source) + bool(source) :]
        return ".".join(f"{target}{'.' if target and rest else ''}{rest}".split(".")[:deepest])
    return target if not path or source.startswith(path + ".") else None


#: What the rows of taints and assignments hold as one table; an assignment's path is the one assigned to.
TAINT, MOVE = range(2)
COLUMNS = {"var": "bigint", "path": "string", "stratum": "int", "from_var": "bigint", "from_path": "string"}


def access_paths(taints: DataFrame, assignments: DataFrame, rule: str, deepest: int = DEEPEST) -> DataFrame:
    """(scope, var, path, stratum): the tainted paths, with the first stratum from which each is there. Scopes of a bounded size go to
    tasks, each whole in one; larger ones go in rounds of joins.

    taints: (scope, var, path, stratum). assignments: (scope, stratum, var, path, from_var, from_path). rule: moved() of
    path, from_path and to_path in Spark's SQL, with the same deepest."""
    tables = [taints, assignments]
    if not whole.are_numbers(tables, ("var", "from_var")):
        return _in_rounds(taints, assignments, rule)
    small, large = whole.dealt(whole.one_table([t.filter("path IS NOT NULL").withColumnRenamed("scope", "proc") for t in tables], COLUMNS))
    kinds = taints.schema
    found = small.mapInArrow(whole.by_procedures(_solver(deepest)), f"scope {kinds['scope'].dataType.simpleString()}, var bigint, path string, stratum int")
    found = found.select("scope", *[F.col(c).cast(kinds[c].dataType).alias(c) for c in ("var", "path", "stratum")])
    rest = taints.filter("scope IS NULL OR path IS NULL").groupBy("scope", "var", "path").agg(F.min("stratum").alias("stratum"))
    if large is not None:
        scopes = large.withColumnRenamed("proc", "scope")
        of = lambda t: t.filter("path IS NOT NULL").join(scopes, "scope", "left_semi")
        found = found.unionByName(_in_rounds(of(taints), of(assignments), rule))
    return found.unionByName(rest)


def _solver(deepest: int):
    """The rounds of some whole scopes: facts and assignments as arrays, paths as their numbers; the rule is asked once for each three paths."""

    def solve(table: pa.Table, proc: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind, stratum = table.column("kind").to_numpy(), whole.numbers(table.column("stratum"))[0]
        (var, no_var), (from_var, no_from) = (whole.numbers(table.column(c)) for c in ("var", "from_var"))
        known, paths = {}, []

        def number(path: str | None) -> int:
            if path not in known:
                known[path] = len(paths)
                paths.append(path)
            return known[path]

        path, from_path = (np.array([number(p) for p in names], np.int64)[at] for at, names in (whole.texts(table.column(c)) for c in ("path", "from_path")))
        # variables by number, 0 for null
        values, code = np.unique(np.concatenate([var, from_var]), return_inverse=True)
        var, from_var = np.where(no_var, 0, code[: len(var)] + 1), code[len(var) :] + 1
        scopes, several = table.column("proc").take(pa.array(whole.runs(proc))), len(values) + 1
        m = np.flatnonzero((kind == MOVE) & ~no_from & (from_path != known.get(None, -1)))
        m = m[np.argsort(proc[m] * several + from_var[m], kind="stable")]
        at, source, to, when = proc[m] * several + from_var[m], from_path[m], path[m], stratum[m]
        ends = proc[m] * several + var[m]
        pair_at, pair = whole.coded(source, to)
        pairs = max(1, len(pair_at))
        t = kind == TAINT
        new = [proc[t] * several + var[t], path[t], stratum[t]]  # place, path, stratum
        held = [x[:0] for x in new]
        asked: dict[int, int] = {}
        while len(new[0]):
            # the first stratum of each, and which of them are new
            both = [np.concatenate(x) for x in zip(held, new, strict=True)]
            order = np.lexsort((np.arange(len(both[0])) >= len(held[0]), both[2], both[1], both[0]))
            where, what = both[0][order], both[1][order]
            best = np.ones(len(order), bool)
            best[1:] = (where[1:] != where[:-1]) | (what[1:] != what[:-1])
            best = order[best]
            fresh = best[best >= len(held[0])]
            held = [x[best] for x in both]
            where, what, since = (x[fresh] for x in both)
            first = np.searchsorted(at, where, "left")
            move, of = whole.spread(first, np.searchsorted(at, where, "right") - first)
            use = since[of] <= when[move]
            # an assignment from null finds nothing: 0 is no number of a variable
            move, of = move[use], of[use]
            keys, back = np.unique(what[of] * pairs + pair[move], return_inverse=True)
            for key in keys.tolist():
                if key not in asked:
                    p, q = divmod(key, pairs)
                    got = _moved(paths[p], paths[source[pair_at[q]]], paths[to[pair_at[q]]], deepest)
                    asked[key] = -1 if got is None else number(got)
            came = np.array([asked[k] for k in keys.tolist()], np.int64)[back] if len(keys) else np.zeros(0, np.int64)
            use = came >= 0
            new = [ends[move[use]], came[use], when[move[use]]]
        of_var = held[0] % several
        yield pa.RecordBatch.from_arrays([
            scopes.take(pa.array(held[0] // several)).combine_chunks(), pa.array(values[np.maximum(of_var, 1) - 1], mask=of_var == 0),
            pa.array(paths, pa.string()).take(pa.array(held[1])), pa.array(held[2].astype(np.int32)),
        ], ["scope", "var", "path", "stratum"])

    return solve


def _in_rounds(taints: DataFrame, assignments: DataFrame, rule: str) -> DataFrame:
    """The same by joins, a round at a time, for scopes of any size. Facts only grow and only get earlier, so a fixpoint ends it."""
    key = ["scope", "var", "path"]
    moves = _cut(assignments.select("scope", F.col("stratum").alias("at"), F.col("var").alias("to_var"), F.col("path").alias("to_path"), F.col("from_var").alias("var"), "from_path").distinct())
    new = _cut(taints.groupBy(*key).agg(F.min("stratum").alias("stratum")))
    parts = [new]
    matches = f"{below('path', 'from_path')} OR {below('from_path', 'path')}"
    while not new.isEmpty():
        step = new.join(moves, ["scope", "var"]).filter(F.col("stratum") <= F.col("at")).filter(matches)
        came = step.select("scope", F.col("to_var").alias("var"), F.expr(rule).alias("path"), F.col("at").alias("stratum")).groupBy(*key).agg(F.min("stratum").alias("stratum"))
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        known = known.groupBy(*key).agg(F.min("stratum").alias("had"))
        new = _cut(came.join(known, key, "left").filter("had IS NULL OR stratum < had").drop("had"))
        parts.append(new)
        if len(parts) == 8:
            parts = [_cut(known.withColumnRenamed("had", "stratum").unionByName(new).groupBy(*key).agg(F.min("stratum").alias("stratum")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*key).agg(F.min("stratum").alias("stratum"))


def queue_elements(operations: DataFrame) -> DataFrame:
    """operations (list, at, op, tainted, index) with, for each read, the push (element) that the index names then, null past the end,
    and whether it is tainted. push adds at the end, pop takes the first and does nothing to an empty list. Sums over windows:
    pops that found nothing are the lowest that pushes minus pops ever were."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("list").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("op") == "push", 1).when(F.col("op") == "pop", -1).otherwise(0)
    run = operations.withColumn("net", F.sum(change).over(order)).withColumn("pushes", F.sum(F.when(F.col("op") == "push", 1).otherwise(0)).over(order))
    run = run.withColumn("idle", F.greatest(F.lit(0), -F.min("net").over(order)))
    run = run.withColumn("gone", F.col("pushes") - F.col("net") - F.col("idle"))
    pushed = run.filter("op = 'push'").select("list", F.col("pushes").alias("nth"), F.col("at").alias("element"), F.col("tainted").alias("is_tainted"))
    reads = run.filter("op = 'read'").withColumn("nth", F.when(F.col("gone") + F.col("index") < F.col("pushes"), F.col("gone") + F.col("index") + 1))
    return reads.join(pushed, ["list", "nth"], "left").select("list", "at", "index", "element", F.coalesce("is_tainted", F.lit(False)).alias("tainted"))
