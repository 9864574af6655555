"""Calls against spec rows, and taint over instruction rows, by equi-joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scan.specs import SINK_TYPES
from .fixpoint import _cut, reachable


# receivers' types that a method is looked up under when its own name is not listed, in this order.
TYPE_PREFIXES = (
    "str", "bytes", "list", "dict", "set", "object", "ConfigParser", "configparser.ConfigParser", "request", "response", "session", "connection", "statement", "PreparedStatement",
    "Statement", "Runtime", "runtime", "ProcessBuilder", "processBuilder", "URLDecoder", "URLEncoder", "java.net.URLDecoder", "java.net.URLEncoder", "Base64", "java.util.Base64", "String",
    "StringBuilder", "StringBuffer", "MessageDigest", "Cipher", "SecretKeySpec", "ObjectInputStream", "ObjectOutputStream", "FileInputStream", "FileOutputStream", "File", "DocumentBuilder",
    "SAXParser", "XMLReader", "XPath", "xpath", "DirContext", "ldapTemplate",
)


def candidates(callee: str = "callee"):
    """What a call's name may be listed under: its dotted suffixes, the whole name first, and then its method under any type ("*.method")."""
    parts = F.split(F.col(callee), "[.]")
    suffixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("cut"), F.array_join(F.slice(parts, i + 1, F.size(parts)), ".").alias("candidate")))
    typed = F.array(F.struct(F.size(parts).alias("cut"), F.concat(F.lit("*."), F.element_at(parts, -1)).alias("candidate")))
    return F.when(F.size(parts) > 1, F.concat(suffixes, typed)).otherwise(suffixes)


def looked_up(sites: DataFrame, rows: DataFrame, key: list[str], callee: str = "callee") -> DataFrame:
    """The row of each role that a call site takes: the longest listed suffix, else the first type that lists the method; a later
    table's row before an earlier one's. Sites are exploded into candidate names and joined on them. Rows of a listed type are also
    filed under "*.method", so that a site asks once for all types; the rows are few and broadcast by size."""
    named = sites.withColumn("c", F.explode(candidates(callee))).select(*sites.columns, "c.cut", "c.candidate")
    listed = rows.select(F.col("name").alias("spec_name"), "role", "kind", "args", "precedence")
    owner, method = F.regexp_extract("spec_name", r"^(.*)[.][^.]*$", 1), F.substring_index("spec_name", ".", -1)
    typed = listed.withColumn("type_rank", F.array_position(F.array(*map(F.lit, TYPE_PREFIXES)), owner).cast("int")).filter("type_rank > 0").withColumn("candidate", F.concat(F.lit("*."), method))
    hit = named.join(listed.withColumn("type_rank", F.lit(0)).withColumn("candidate", F.col("spec_name")).unionByName(typed), "candidate").drop("candidate")
    best = Window.partitionBy(*key, "role").orderBy("cut", "type_rank", F.desc("precedence"), "kind")
    return hit.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r", "type_rank")


def findings(facts: DataFrame, rows: DataFrame, language: str) -> DataFrame:
    """file, proc, line, type, source_line: what a source call reaches along assignments and hands to a sink. Every step is a join
    on (file, proc, variable); taint is followed to a fixpoint."""
    rows = rows.filter(F.col("language") == language)
    facts = facts.filter("error IS NULL")
    named = _cut(looked_up(facts.filter("callee IS NOT NULL").select("file", "proc", "seq", "op", "line", "callee", "target", "reads"), rows, ["file", "proc", "seq", "op"]).drop("args"))
    node = lambda c: F.concat_ws("|", "file", "proc", c)
    assigns = facts.filter("op = 'assign' AND target IS NOT NULL")
    made = named.filter("op = 'assign'")
    seeds = made.filter("role = 'source'").select(node("target").alias("node"), F.col("line").alias("source_line"))
    cleaned = made.filter("role = 'sanitizer'").select("file", "proc", "seq", "op")
    edges = assigns.join(cleaned, ["file", "proc", "seq", "op"], "left_anti").withColumn("r", F.explode("reads")).select(node("r").alias("src"), node("target").alias("dst"))
    tainted = reachable(seeds, edges, ["source_line"])
    kinds = F.create_map(*[F.lit(x) for pair in SINK_TYPES.items() for x in pair])
    sinks = named.filter("op = 'call' AND role = 'sink'").withColumn("r", F.explode("reads")).select("file", "proc", "line", F.coalesce(kinds[F.col("kind")], F.lit("taint_flow")).alias("type"), node("r").alias("node"))
    return sinks.join(tainted, "node").groupBy("file", "proc", "line", "type").agg(F.min("source_line").alias("source_line"))


def argument_sinks(facts: DataFrame, rows: DataFrame, language: str) -> DataFrame:
    """file, callee, place, line: calls of functions of the same file whose argument of a place is a tainted variable, where the
    callee's parameter of that place is handed to a sink. Joins on (file, procedure, variable) and on (file, callee, place)."""
    rows = rows.filter(F.col("language") == language)
    facts = facts.filter("error IS NULL")
    named = _cut(looked_up(facts.filter("callee IS NOT NULL").select("file", "proc", "seq", "op", "line", "callee", "target", "reads"), rows, ["file", "proc", "seq", "op"]).drop("args"))
    sinks = named.filter("op = 'call' AND role = 'sink'").select("file", "proc", F.explode("reads").alias("name"))
    params = facts.select("file", "proc", F.posexplode("params").alias("place", "name")).distinct()
    exposed = params.join(sinks, ["file", "proc", "name"], "left_semi").select("file", F.col("proc").alias("callee"), "place")
    tainted = named.filter("op = 'assign' AND role = 'source'").select("file", "proc", F.col("target").alias("name")).distinct()
    given = facts.filter("op = 'call'").select("file", "proc", "callee", "line", F.posexplode("args").alias("place", "name"))
    return given.join(tainted, ["file", "proc", "name"], "left_semi").join(exposed, ["file", "callee", "place"]).select("file", "callee", "place", "line").distinct()
