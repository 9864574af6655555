"""Findings, manifests and programs from files in the formats that tools exchange, as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "struct<type:string,severity:string,cwe_id:string,location:string,line:int,confidence:double,description:string>"


def read_findings(texts: DataFrame, column: str = "text") -> DataFrame:
    """A row for each finding of a JSON text: a list of findings, an object with `vulnerabilities`, or one with `files` of such."""
    listed = F.from_json(column, f"array<{FINDING}>")
    whole = F.from_json(column, f"struct<vulnerabilities:array<{FINDING}>,files:array<struct<filename:string,vulnerabilities:array<{FINDING}>>>>")
    nested = F.flatten(F.transform(whole["files"], lambda f: F.coalesce(f["vulnerabilities"], F.array().cast(f"array<{FINDING}>"))))
    found = F.when(F.ltrim(column).startswith("["), listed).otherwise(F.coalesce(whole["vulnerabilities"], nested))
    keep = [c for c in texts.columns if c != column]
    return texts.select(*keep, F.explode(found).alias("f")).select(*keep, "f.*")


SARIF = (
    "struct<runs:array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,kind:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>,fingerprints:map<string,string>,partialFingerprints:map<string,string>>>>>>"
)


def read_sarif(texts: DataFrame, rules: DataFrame, column: str = "text") -> DataFrame:
    """A row for each result of each run of a SARIF text, in order: rule, weakness by the rules' table (rule_id, cwe; none is made up),
    level, severity, message, path, line and the first of its fingerprints by text."""
    keep = [c for c in texts.columns if c != column]
    runs = texts.select(*keep, F.flatten(F.transform(F.from_json(column, SARIF)["runs"], lambda r: F.coalesce(r["results"], F.array()))).alias("results"))
    rows = runs.select(*keep, F.posexplode("results").alias("result_index", "r"))
    at = F.element_at("r.locations", 1)["physicalLocation"]
    level = F.coalesce("r.level", "r.kind")
    prints = F.coalesce("r.fingerprints", "r.partialFingerprints")
    severity = F.when(level == "error", "high").when(level == "warning", "medium").when(level == "note", "low").when(level == "none", "info")
    out = rows.select(
        *keep,
        "result_index",
        F.col("r.ruleId").alias("rule_id"),
        level.alias("level"),
        severity.alias("severity"),
        F.trim(F.coalesce("r.message.text", F.lit(""))).alias("message"),
        at["artifactLocation"]["uri"].alias("path"),
        at["region"]["startLine"].alias("line"),
        F.array_min(F.map_values(prints)).alias("fingerprint"),
    )
    return out.join(rules, "rule_id", "left")


def read_scanner_json(texts: DataFrame, column: str = "text") -> DataFrame:
    """A row for each weakness of each result of another scanner's JSON (results, extra.metadata.cwe as a text or a list of texts);
    results without a weakness number give none."""
    shape = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,metadata:struct<cwe:{}>>>>>"
    keep = [c for c in texts.columns if c != column]
    many = texts.select(*keep, F.explode(F.from_json(column, shape.format("string"))["results"]).alias("r"))
    raw = F.col("r.extra.metadata.cwe")
    named = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    rows = many.select(*keep, F.col("r.path").alias("path"), F.col("r.start.line").alias("line"), F.col("r.check_id").alias("rule_id"), F.col("r.extra.severity").alias("severity"), F.explode(named).alias("raw"))
    number = F.coalesce(F.nullif(F.regexp_extract(F.upper("raw"), r"CWE[-\s_]*(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract("raw", r"^\s*(\d+)\s*$", 1), F.lit("")))
    return rows.withColumn("cwe", F.concat(F.lit("CWE-"), number.cast("int").cast("string"))).filter("cwe IS NOT NULL").drop("raw")


class YamlProblem(ValueError):
    pass


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", text[1:-1]) if x.strip()]
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text, text)


def _bare(line: str) -> str:
    """The line without its comment: a # at the beginning or after a space, outside of quoted scalars."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (not line[:i].strip() or line[i - 1] in " [,:{-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


def parse_yaml(text: str):
    """Maps, lists, quoted and plain scalars, inline lists and comments by indentation: what manifests are written in."""
    rows = []
    for n, line in enumerate(text.split("\n"), 1):
        bare = _bare(line)
        if bare.strip():
            rows.append((len(bare) - len(bare.lstrip(" ")), bare.strip(), n))
    at = 0

    def block(indent: int):
        nonlocal at
        if at >= len(rows):
            return None
        out = [] if rows[at][1].startswith("- ") or rows[at][1] == "-" else {}
        while at < len(rows) and rows[at][0] >= indent:
            depth, body, n = rows[at]
            if depth > indent:
                raise YamlProblem(f"line {n}: indentation")
            if isinstance(out, list):
                if not body.startswith("-"):
                    break
                rest = body[1:].strip()
                if not rest:
                    at += 1
                    out.append(block(rows[at][0]) if at < len(rows) and rows[at][0] > indent else None)
                elif re.match(r"[\w.-]+:(\s|$)", rest):
                    rows[at] = (depth + len(body) - len(rest), rest, n)
                    out.append(block(rows[at][0]))
                else:
                    out.append(_scalar(rest))
                    at += 1
                continue
            m = re.match(r"([\w.\-/ ]+|\"[^\"]*\"):(?:\s+(.*))?$", body)
            if not m:
                raise YamlProblem(f"line {n}: {body[:30]!r}")
            key = _scalar(m[1])
            at += 1
            if m[2] is None or not m[2].strip():
                nested = at < len(rows) and (rows[at][0] > indent or rows[at][0] == indent and rows[at][1].startswith("-"))
                out[key] = block(rows[at][0]) if nested else None
            else:
                out[key] = _scalar(m[2])
        return out

    value = block(rows[0][0]) if rows else None
    if at < len(rows):
        raise YamlProblem(f"line {rows[at][2]}: {rows[at][1][:30]!r}")
    return value


CASES = "name string, slug string, case_id string, expected string, class string, file string, start_line int, end_line int, cwes array<string>, error string"


def read_manifests(texts: DataFrame, name: str = "name", column: str = "text") -> DataFrame:
    """A row for each case of each repository of a YAML manifest; a manifest that does not parse gives one row with its error."""

    def rows(label: str, text: str | None) -> list[tuple]:
        try:
            data = parse_yaml(text or "") or {}
            out = []
            for r in data.get("repositories") or []:
                for c in r.get("cases") or []:
                    out.append((label, r.get("slug"), c.get("id"), c.get("expected"), c.get("class"), c.get("file"), c.get("start_line"), c.get("end_line"), [str(x) for x in c.get("acceptable_cwes") or []], None))
            return out
        except (YamlProblem, AttributeError, TypeError) as e:
            return [(label, *[None] * 7, None, str(e)[:200])]

    from ..scan.engine import _batches

    return texts.select(F.col(name).cast("string"), F.col(column).cast("string")).mapInArrow(_batches(CASES, rows), CASES)


def read_programs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(filename, text): whole files below a folder, byte-order marks dropped."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.input_file_name().alias("filename"), F.regexp_replace("value", "^﻿", "").alias("text"))


def adjudicated(findings: DataFrame, call, key: list[str], schema: str = "is_true_positive boolean, confidence double") -> DataFrame:
    """Every finding with the verdict of a callable: call(row as a dict) -> (is true positive, confidence). It runs where the rows
    are; one that fails gives nulls, which triage escalates."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out_schema = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in findings.select(*key).schema) + ", " + schema)
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    verdict = call(r)
                except Exception:  # noqa: BLE001  a verdict that fails is no verdict
                    verdict = (None, None)
                rows.append((*(r[k] for k in key), *verdict))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return findings.mapInArrow(run, out_schema)


__all__ = ["adjudicated", "parse_yaml", "read_findings", "read_manifests", "read_programs", "read_sarif", "read_scanner_json"]
