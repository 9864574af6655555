"""Facts through calls with matched returns: what a procedure makes of a fact is found once for each fact it is entered with, and
goes back only to the calls that entered it so. What a fact becomes inside a procedure, between the places where it can come in (the
entry, or where a call returns to) and those where it can leave (calls and exits), is found for all procedures at once before. Over
that, the places where a fact came in and the summaries of whole procedures are two growing tables that feed each other; each round
joins only what the last one added, so recursion and chains of any depth and order end by themselves, a round for each call of a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flow as facts
from .fixpoint import _cut, _drop

PATH = ["proc", "given", "node", "fact"]


#: A node and a fact as one number.
POINT = "shiftleft(CAST({0} AS BIGINT), 32) | (CAST({1} AS BIGINT) & 4294967295)"


def _points(rows: DataFrame, proc: str, node: str, fact: str) -> DataFrame:
    return rows.select(F.col(proc).alias("proc"), F.expr(POINT.format(node, fact)).alias("node"))


def _parts(point: str, node: str, fact: str, kinds: dict[str, str]) -> list:
    """A point's node and fact."""
    return [F.expr(f"shiftright({point}, 32)").cast(kinds["node"]).alias(node), F.expr(f"shiftright(shiftleft({point}, 32), 32)").cast(kinds["fact"]).alias(fact)]


def tabulate(flow: DataFrame, calls: DataFrame, returns: DataFrame, starts: DataFrame, tell: DataFrame | None = None) -> DataFrame:
    """(proc, given, node, fact): fact holds at node on some way into proc with the fact given, every call returning to its caller.

    flow: (proc, node, fact, to_node, to_fact), steps inside procedures, those past a call included. calls: (proc, node, fact,
    callee, entry, entry_fact). returns: (proc, node, callee, exit, exit_fact, to_node, to_fact). starts: (proc, node, fact). Nodes
    and facts are integers. tell: (proc, node, fact), what to tell of; all if it is not given."""
    calls, returns = _cut(calls.distinct()), _cut(returns.distinct())
    kinds = dict(starts.dtypes)
    steps = flow.select("proc", F.expr(POINT.format("node", "fact")).alias("src"), F.expr(POINT.format("to_node", "to_fact")).alias("dst"))
    comes = _points(starts, "proc", "node", "fact").unionByName(_points(calls, "callee", "entry", "entry_fact")).unionByName(_points(returns, "proc", "to_node", "to_fact"))
    leaves = _points(calls, "proc", "node", "fact").unionByName(_points(returns, "callee", "exit", "exit_fact"))
    leaves = None if tell is None else leaves.unionByName(_points(tell, "proc", "node", "fact"))
    between = facts.flow_facts(steps, comes, at_start=comes.select("proc", "node", F.col("node").alias("fact"), F.lit(0).alias("part")), ask="may", tell=leaves)
    inside = _cut(between.select("proc", *_parts("fact", "node", "fact", kinds), *_parts("node", "to_node", "to_fact", kinds)))
    asks = _cut(inside.join(calls.select("proc", F.col("node").alias("to_node"), F.col("fact").alias("to_fact"), "callee", "entry", "entry_fact"), ["proc", "to_node", "to_fact"]).select("proc", "node", "fact", F.col("to_node").alias("at"), "callee", "entry", "entry_fact"))
    exits = returns.select(F.col("callee").alias("proc"), F.col("exit").alias("to_node"), F.col("exit_fact").alias("to_fact")).distinct()
    ends = _cut(inside.join(exits, ["proc", "to_node", "to_fact"]).select("proc", "node", "fact", F.col("to_node").alias("exit"), F.col("to_fact").alias("exit_fact")))
    new = _cut(starts.select("proc", F.col("fact").alias("given"), "node", "fact").distinct())
    parts, waiting, ended = [new], None, None
    while not new.isEmpty():
        # one table holds who asks what of a callee, and what a callee entered with a fact ends with
        asked = new.join(asks, ["proc", "node", "fact"]).select("proc", "given", F.col("at").alias("node"), "callee", "entry", "entry_fact", F.lit(None).cast(kinds["node"]).alias("exit"), F.lit(None).cast(kinds["fact"]).alias("exit_fact"))
        done = new.join(ends, ["proc", "node", "fact"]).select(F.lit(None).cast(kinds["proc"]).alias("proc"), F.lit(None).cast(kinds["fact"]).alias("given"), F.lit(None).cast(kinds["node"]).alias("node"), F.col("proc").alias("callee"), F.lit(None).cast(kinds["node"]).alias("entry"), F.col("given").alias("entry_fact"), "exit", "exit_fact")
        both = _cut(asked.unionByName(done).distinct())
        asked, done = both.filter("exit IS NULL").drop("exit", "exit_fact"), both.filter("exit IS NOT NULL").select("callee", "entry_fact", "exit", "exit_fact")
        entered = asked.select(F.col("callee").alias("proc"), F.col("entry_fact").alias("given"), F.col("entry").alias("node"), F.col("entry_fact").alias("fact"))
        met = asked.join(done if ended is None else ended.unionByName(done), ["callee", "entry_fact"])
        if waiting is not None:
            met = met.unionByName(waiting.join(done, ["callee", "entry_fact"]))
        back = met.select("proc", "given", "node", "callee", "exit", "exit_fact").join(returns, ["proc", "node", "callee", "exit", "exit_fact"]).select("proc", "given", F.col("to_node").alias("node"), F.col("to_fact").alias("fact"))
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        new = _cut(entered.unionByName(back).distinct().join(known, PATH, "left_anti"))
        waiting = asked if waiting is None else waiting.unionByName(asked)
        ended = done if ended is None else ended.unionByName(done)
        parts.append(new)
        if len(parts) == 8:
            whole, waiting, ended = _cut(known.unionByName(new)), _cut(waiting), _cut(ended)
            for p in parts[:-1]:
                _drop(p)
            parts = [whole]
    came = parts[0]
    for p in parts[1:]:
        came = came.unionByName(p)
    told = inside if tell is None else inside.join(tell.select("proc", F.col("node").alias("to_node"), F.col("fact").alias("to_fact")).distinct(), ["proc", "to_node", "to_fact"], "left_semi")
    return came.join(told, ["proc", "node", "fact"]).select("proc", "given", F.col("to_node").alias("node"), F.col("to_fact").alias("fact")).distinct()


def summaries(paths: DataFrame, exits: DataFrame) -> DataFrame:
    """(proc, given, fact): what holds at a procedure's exits (proc, node) of what it was entered with."""
    return paths.join(exits, ["proc", "node"]).select("proc", "given", "fact").distinct()
