"""Findings as DataFrames: SARIF in and out, anchored line clusters, one-to-one matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fixpoint import _cut
from .matching import one_to_one

SARIF = "struct<version:string,runs:array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,name:string>>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>>"


def level(severity: str = "severity"):
    return F.when(F.col(severity).isin("critical", "high"), "error").when(F.col(severity) == "medium", "warning").otherwise("note")


def to_sarif(found: DataFrame, tool: str = "faultline") -> DataFrame:
    """One SARIF document for each file (location): a run's results are collected per file, never over the whole corpus."""
    result = F.struct(
        F.coalesce("cwe", "type").alias("ruleId"),
        level().alias("level"),
        F.struct(F.col("type").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("location").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").cast("int").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    rule = F.struct(F.coalesce("cwe", "type").alias("id"), F.col("type").alias("name"))
    files = found.groupBy("location").agg(F.array_sort(F.collect_set(rule)).alias("rules"), F.collect_list(result).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return files.select("location", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def read_sarif(texts: DataFrame, column: str = "sarif") -> DataFrame:
    """(rule_id, level, message, location, line) of every result in every run."""
    runs = texts.select(F.explode(F.from_json(column, SARIF)["runs"]).alias("run")).select(F.explode("run.results").alias("r"))
    where = F.col("r.locations")[0]["physicalLocation"]
    return runs.select(F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), F.col("r.message.text").alias("message"), where["artifactLocation"]["uri"].alias("location"), where["region"]["startLine"].alias("line"))


def anchored_clusters(rows: DataFrame, keys: list[str], line: str, reach: int) -> DataFrame:
    """The distinct lines of each key with the anchor of their cluster: the first line of a cluster takes all lines within reach of it,
    then the next begins. Each line knows by a window the first line beyond its reach; following that from a key's first line, in
    steps that double each round, marks the anchors. A key of any size is sorted, never gathered into a row."""
    lines = _cut(rows.select(*keys, F.col(line).cast("int").alias("at")).filter("at IS NOT NULL").distinct())
    asked = lines.select(*keys, (F.col("at") + reach + 1).alias("pos"), F.lit(None).cast("int").alias("found"), "at").unionByName(lines.select(*keys, F.col("at").alias("pos"), F.col("at").alias("found"), F.lit(None).cast("int").alias("at")))
    beyond = Window.partitionBy(*keys).orderBy(F.desc("pos"), F.desc_nulls_last("found")).rowsBetween(Window.unboundedPreceding, 0)
    jump = _cut(asked.withColumn("next", F.last("found", True).over(beyond)).filter("at IS NOT NULL AND next IS NOT NULL").select(*keys, "at", "next"))
    anchors = _cut(lines.groupBy(*keys).agg(F.min("at").alias("at")))
    same = lambda a, b: reduce(lambda x, k: x & a[k].eqNullSafe(b[k]), keys, F.lit(True))
    while not jump.isEmpty():
        more = anchors.join(jump, same(anchors, jump) & (anchors["at"] == jump["at"])).select(*[anchors[k] for k in keys], F.col("next").alias("at"))
        anchors = _cut(anchors.unionByName(more).distinct())
        far = jump.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("at").alias("_at"), F.col("next").alias("further"))
        onward = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.col("next") == F.col("_at"))
        jump = _cut(jump.join(far, onward).select(*keys, "at", F.col("further").alias("next")))
    marked = lines.withColumn("anchor", F.lit(None).cast("int")).unionByName(anchors.withColumn("anchor", F.col("at")))
    marked = marked.groupBy(*keys, "at").agg(F.max("anchor").alias("anchor"))
    upto = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select(*keys, F.col("at").alias(line), F.last("anchor", True).over(upto).alias("anchor"))


def greedy_matches(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches inside each key, nearest first: pairs (keys, left_line int, right_line int). Ties go by left_line, then right_line."""
    near = pairs.select(*keys, F.col("left_line").alias("left"), F.col("right_line").alias("right"), F.abs(F.col("left_line") - F.col("right_line")).alias("gap"))
    return one_to_one(near, keys, ["gap"]).select(*keys, F.col("left").alias("left_line"), F.col("right").alias("right_line"))
