"""Rules on lines of source text, in the JVM: comments go, lines are exploded, and each rule is a pair of patterns on a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scan.detect import LINE_RULES


def without_block_comments(text):
    """The text with /* */ comments replaced by their line breaks, so that lines keep their numbers."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)/\*.*?\*/|[^/]+|/"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("/*"), F.regexp_replace(p, "[^\n]", "")).otherwise(p)), "")


def c_line_rules(sources: DataFrame, file: str = "filename", text: str = "text", rules: tuple = LINE_RULES) -> DataFrame:
    """(file, line, cwe) of the rules (weakness number, what a line has, what it must not have); a null text has no lines."""
    plain = sources.select(F.col(file).cast("string").alias("file"), F.posexplode(F.split(without_block_comments(F.col(text).cast("string")), "\n")).alias("at", "body"))
    lines = plain.select("file", (F.col("at") + 1).alias("line"), F.regexp_replace("body", "//.*", "").alias("body")).filter(F.trim("body") != "")
    hits = F.array(*[F.when(F.col("body").rlike(has) & ~F.col("body").rlike(lacks), F.lit(f"CWE-{cwe}")) for cwe, has, lacks in rules])
    return lines.select("file", "line", F.explode(F.array_compact(hits)).alias("cwe"))
