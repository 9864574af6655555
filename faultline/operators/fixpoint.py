"""Semi-naive fixpoints over DataFrames. Every round joins only what the last one added; rounds are written to the shared folder."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds of the searches whose rounds grow with the logarithm of a diameter; beyond it something is wrong.
MAX_ROUNDS = 64


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share: in spark.checkpoint.dir; where that is unset, a temp folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/faultline/{name}-{uuid.uuid4().hex}"


def _cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and every executor can read it again."""
    path = new_folder(df.sparkSession, "fixpoint")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._faultline_path = path
    return out


def _drop(df: DataFrame) -> None:
    """Deletes what _cut wrote, once nothing reads it any more."""
    if path := getattr(df, "_faultline_path", None):
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of tables that nothing refers to any more go when the driver collects garbage; on large inputs that is too late for the disk."""
    gc.collect()
    spark._jvm.System.gc()


def reachable(seeds: DataFrame, edges: DataFrame, carried: list[str] | None = None, max_rounds: int | None = None) -> DataFrame:
    """(node, *carried, depth): nodes reachable from the seeds (node, *carried) over edges (src, dst, and any carried column that edges restrict), with the least number of steps. A round that adds nothing ends it, on cycles too; there is no bound unless one is given, and running out of it is an error, never a silent cut."""
    carried = carried or []
    key = ["node", *carried]
    shared = [c for c in carried if c in edges.columns]
    edges = _cut(edges.select("src", "dst", *shared).distinct())  # one shuffle; every round reads them again
    new = _cut(seeds.select(*key).distinct().withColumn("depth", F.lit(0)))
    known, parts = new, [new]
    step = 0
    while max_rounds is None or step < max_rounds:
        step += 1
        moved = new.withColumnRenamed("node", "src").join(edges, ["src", *shared]).select(F.col("dst").alias("node"), *carried).distinct()
        new = _cut(moved.join(known, key, "left_anti").withColumn("depth", F.lit(step)))
        if new.isEmpty():
            _drop(edges)
            return known
        known = known.unionByName(new)
        parts.append(new)
        if len(parts) == 8:
            known = _cut(known)
            for p in parts[:-1]:
                _drop(p)
            parts = [known]
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.min("depth").alias("depth"))


def _nearer(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known.select(F.col("node").alias("at"), F.col("depth").alias("had")), F.expr("node <=> at"), "left").filter("had IS NULL OR depth < had").select("node", "depth")


def far_reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): as reachable(), where ways are long: a node with one edge is passed by pointers that double, so a way through such
    nodes takes as many rounds as the logarithm of its length; a node with several edges takes a round, and a node that comes nearer goes again."""
    edges = _cut(edges.select("src", "dst").filter("src IS NOT NULL").distinct())
    several = edges.groupBy("src").count().filter("count > 1").select("src")
    branching = _cut(edges.join(several, "src", "left_semi"))
    jumps = [_cut(edges.join(several, "src", "left_anti"))]  # where 2 ** i steps lead, by i
    branches = not branching.isEmpty()
    new = _cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    known = None
    while known is None or not new.isEmpty():
        rode = new
        for i in range(31):  # a depth is an int
            moved = rode.withColumnRenamed("node", "src").join(jumps[i], "src").select(F.col("dst").alias("node"), (F.col("depth") + F.lit(1 << i)).alias("depth"))
            # a way that closes brings no nearer nodes
            more = _cut(_least(rode.unionByName(moved)))
            same = more.exceptAll(rode).isEmpty()
            if rode is not new:
                _drop(rode)
            rode = more
            if same:
                break
            if len(jumps) == i + 1:
                half = jumps[i]
                jumps.append(_cut(half.join(half.select(F.col("src").alias("dst"), F.col("dst").alias("further")), "dst").select("src", F.col("further").alias("dst"))))
                if not branches:
                    _drop(half)
        else:
            raise RuntimeError(f"no fixpoint within 31 rounds")
        had = known
        known = rode if had is None else _cut(_least(had.unionByName(rode)))
        if not branches:
            break
        came = _least((rode if had is None else _nearer(rode, had)).withColumnRenamed("node", "src").join(branching, "src").select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")))
        new = _cut(_nearer(came, known))
    return known


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, label): the least node connected to each, by label exchange with pointer jumping; rounds grow with the logarithm of the diameter."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = _cut(both)
    labels = _cut(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "node"))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = _cut(step.join(jump, "label").select("node", F.least("label", "further").alias("label")))
        changed = not new.join(labels, ["node", "label"], "left_anti").isEmpty()
        _drop(labels)
        labels = new
        if not changed:
            _drop(both)
            return labels
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")


def must_hold(nodes: DataFrame, edges: DataFrame, entry: DataFrame, kills: DataFrame) -> DataFrame:
    """(node, fact) that hold on every path from the entry. The complement is iterated, as it only grows: a fact may fail at a node if it fails at a predecessor or is killed there. entry: (node, fact) that hold at the start; kills: (node, fact). Each node's failing facts are set against the array of all facts, which is small: facts of one analysis, not of the data."""
    facts = entry.groupBy().agg(F.array_sort(F.collect_set("fact")).alias("facts"))
    starts = entry.groupBy("node").agg(F.collect_set("fact").alias("have"))
    at_start = starts.join(F.broadcast(facts)).select("node", F.explode(F.array_except("facts", "have")).alias("fact"))
    fails = reachable(at_start.unionByName(kills.select("node", "fact")), edges, ["fact"]).groupBy("node").agg(F.collect_set("fact").alias("failing"))
    reached = reachable(starts.select("node"), edges).select("node")
    held = nodes.select("node").join(reached, "node", "left_semi").join(fails, "node", "left").join(F.broadcast(facts))
    return held.select("node", F.explode(F.array_except("facts", F.coalesce("failing", F.expr("slice(facts, 1, 0)")))).alias("fact"))
