"""Queries over files that they write first: findings, manifests and programs in the formats that tools exchange; and the points where
users put in their own rows and functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators.fixpoint import new_folder
from ..scan import engine
from ..sources import readers, sarif
from . import cases, views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _through_files(df: DataFrame, name: str) -> DataFrame:
    """The texts of a column, written as JSON lines and read back."""
    folder = new_folder(df.sparkSession, name)
    df.write.json(folder)
    return df.sparkSession.read.schema(df.schema).json(folder)


_ONE = "SELECT p_partkey, concat('{\"type\": \"t', p_size % 5, '\", \"severity\": \"', if(p_size % 2 = 0, 'high', 'low'), '\", \"cwe_id\": \"CWE-', p_size, '\", \"location\": \"src/', p_brand, '\", \"line\": ', p_size, ', \"confidence\": 0.', p_partkey % 10, '}') AS f FROM part"


def findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('[', f, ', ', f, ']') WHEN 1 THEN concat('{{"vulnerabilities": [', f, ']}}') WHEN 2 THEN concat('{{"files": [{{"filename": "a", "vulnerabilities": [', f, ']}}, {{"filename": "b"}}, {{"filename": "c", "vulnerabilities": [', f, ', ', f, ']}}]}}') ELSE '{{"summary": 1}}' END AS text FROM ({_ONE}) o""".replace("{{", "{").replace("}}", "}")
    return readers.read_findings(_through_files(views.run(spark, sf_dir, text), "findings")).select("p_partkey", "type", "severity", "cwe_id", "location", "line", F.round("confidence", 1).alias("confidence"))


QUERIES["A9_findings_json"] = findings_json
ORACLES["A9_findings_json"] = """SELECT p_partkey, 't' || CAST(p_size % 5 AS STRING) AS type, CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'low' END AS severity, 'CWE-' || CAST(p_size AS STRING) AS cwe_id, 'src/' || p_brand AS location, p_size AS line, round(CAST(p_partkey % 10 AS DOUBLE) / 10, 1) AS confidence
  FROM part JOIN (VALUES (0, 2), (1, 1), (2, 3)) AS c(kind, times) ON p_partkey % 4 = kind JOIN (VALUES (1), (2), (3)) AS n(i) ON i <= times"""


def sarif_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result with all fields, one with few, in two runs; rules through the table of types."""
    text = """SELECT p_partkey, concat('{"version": "2.1.0", "runs": [{"results": [{"ruleId": "', CASE p_size % 3 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'xss' ELSE 'own_rule' END, '", "level": "', CASE p_size % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'note' ELSE 'none' END,
      '", "message": {"text": " m', p_size, ' "}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a/', p_partkey, '.py"}, "region": {"startLine": ', p_size, '}}}], "partialFingerprints": {"z": "f2", "a": "f', p_size % 3, '"}}]}, {"tool": {}}, {"results": [{"ruleId": "xss", "kind": "fail"}]}]}') AS text FROM part"""
    rules = views.run(spark, sf_dir, "SELECT type AS rule_id, cwe FROM vuln")
    return readers.read_sarif(_through_files(views.run(spark, sf_dir, text), "sarif"), rules).select("p_partkey", "result_index", "rule_id", "level", "severity", "message", "path", "line", "fingerprint", "cwe")


QUERIES["A10_sarif_files"] = sarif_files
ORACLES["A10_sarif_files"] = """SELECT p_partkey, CAST(0 AS INT) AS result_index, r.rule AS rule_id, l.level, l.severity, 'm' || CAST(p_size AS STRING) AS message, 'a/' || CAST(p_partkey AS STRING) || '.py' AS path, p_size AS line, 'f' || CAST(p_size % 3 AS STRING) AS fingerprint, v.cwe
  FROM part JOIN (VALUES (0, 'sql_injection'), (1, 'xss'), (2, 'own_rule')) AS r(i, rule) ON p_size % 3 = r.i JOIN (VALUES (0, 'error', 'high'), (1, 'warning', 'medium'), (2, 'note', 'low'), (3, 'none', 'info')) AS l(i, level, severity) ON p_size % 4 = l.i LEFT JOIN vuln v ON v.type = r.rule
  UNION ALL SELECT p_partkey, 1, 'xss', 'fail', NULL, '', NULL, NULL, NULL, 'CWE-79' FROM part"""


def sarif_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written and read again as files of the SARIF data source; the filter on levels is applied by the reader."""
    sarif.register(spark)
    folder = new_folder(spark, "sarif-source")
    found = views.run(spark, sf_dir, "SELECT DISTINCT location, line, type, cwe, severity FROM v_finding")
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    found.select(F.coalesce("cwe", "type").alias("rule_id"), level.alias("level"), F.col("type").alias("message"), "location", "line").write.format("sarif").mode("append").save(folder)
    read = spark.read.format("sarif").option("rangeBytes", 1 << 18).load(folder).filter("level = 'error'")
    return read.groupBy("rule_id", "location").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.min("message").alias("type"))


QUERIES["A18_sarif_source"] = sarif_source
ORACLES["A18_sarif_source"] = "SELECT coalesce(cwe, type) AS rule_id, location, count(*) AS n, min(line) AS first_line, min(type) AS type FROM (SELECT DISTINCT location, line, type, cwe, severity FROM v_finding) f WHERE severity IN ('critical', 'high') GROUP BY coalesce(cwe, type), location"


def scanner_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """SELECT p_partkey, concat('{"results": [{"check_id": "r', p_size % 7, '", "path": "p/', p_brand, '", "start": {"line": ', p_size, '}, "extra": {"severity": "ERROR", "metadata": {"cwe": ',
      CASE p_partkey % 4 WHEN 0 THEN concat('"CWE-', p_size, ': Some Text"') WHEN 1 THEN concat('["CWE-', p_size, ': a", "cwe_0', p_size, '", "none"]') WHEN 2 THEN '"no number"' ELSE concat('"', p_size, '"') END, '}}}, {"check_id": "x", "path": "q"}]}') AS text FROM part"""
    return readers.read_scanner_json(_through_files(views.run(spark, sf_dir, text), "scanner")).select("p_partkey", "path", "line", "rule_id", "severity", "cwe")


QUERIES["A11_scanner_json"] = scanner_files
ORACLES["A11_scanner_json"] = """SELECT p_partkey, 'p/' || p_brand AS path, p_size AS line, 'r' || CAST(p_size % 7 AS STRING) AS rule_id, 'ERROR' AS severity, 'CWE-' || CAST(p_size AS STRING) AS cwe
  FROM part JOIN (VALUES (0, 1), (1, 2), (3, 1)) AS c(kind, times) ON p_partkey % 4 = kind JOIN (VALUES (1), (2)) AS n(i) ON i <= times"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each part: one repository with one or two cases, one manifest in seven broken."""
    text = """SELECT CAST(p_partkey AS STRING) AS name, CASE WHEN p_partkey % 7 = 0 THEN concat('version: 1', char(10), '   bad', char(10), ' x: 1') ELSE concat('# manifest', char(10), 'version: 1', char(10), 'repositories:', char(10), '  - slug: repo', p_size % 3, char(10), '    upstream: "https://h/x:', p_size, '"', char(10), '    cases:', char(10),
      '      - id: c', p_partkey, char(10), '        expected: vulnerable', char(10), '        class: idor', char(10), '        file: ''a/b.py''', char(10), '        start_line: ', p_size, char(10), '        end_line: ', p_size + 4, char(10), '        acceptable_cwes: [CWE-639, CWE-', p_size, ']', char(10),
      if(p_partkey % 2 = 0, concat('      - id: s', p_partkey, char(10), '        expected: safe', char(10), '        acceptable_cwes:', char(10), '          - CWE-862', char(10)), '')) END AS text FROM part"""
    rows = readers.read_manifests(_through_files(views.run(spark, sf_dir, text), "manifests"))
    return rows.select("name", "slug", "case_id", "expected", "file", "start_line", "end_line", F.array_join("cwes", ",").alias("cwes"), F.col("error").isNotNull().alias("failed"))


QUERIES["A13_manifests"] = manifests
ORACLES["A13_manifests"] = """SELECT CAST(p_partkey AS STRING) AS name, 'repo' || CAST(p_size % 3 AS STRING) AS slug, 'c' || CAST(p_partkey AS STRING) AS case_id, 'vulnerable' AS expected, 'a/b.py' AS file, p_size AS start_line, CAST(p_size + 4 AS INT) AS end_line, 'CWE-639,CWE-' || CAST(p_size AS STRING) AS cwes, false AS failed FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT CAST(p_partkey AS STRING), 'repo' || CAST(p_size % 3 AS STRING), 's' || CAST(p_partkey AS STRING), 'safe', NULL, NULL, NULL, 'CWE-862', false FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 2 = 0
  UNION ALL SELECT CAST(p_partkey AS STRING), NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM part WHERE p_partkey % 7 = 0"""


def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled programs as files below a folder, a file each, read again by pattern and scanned."""
    folder = new_folder(spark, "programs")
    rows = [(f"p{i}{suffix}", text.replace("QQ", "1")) for i, suffix, _, text in cases.CASES]
    spark.createDataFrame(rows, "file string, value string").repartition(8, "file").write.partitionBy("file").text(folder)
    found = engine.scan(readers.read_programs(spark, folder, "part-*").select(F.regexp_extract("filename", "file=([^/]+)", 1).alias("filename"), "text"))
    return found.filter("error IS NULL").select(F.col("file").alias("filename"), "line", "type", "source_line")


QUERIES["A2_folder_scan"] = folder_scan
ORACLES["A2_folder_scan"] = "SELECT * FROM (VALUES " + ", ".join(f"('p{c}{cases.CASES[c][1]}', {line}, '{kind}', {'CAST(NULL AS INT)' if s is None else s})" for c, line, kind, s in cases.LABELS) + ") AS t(filename, line, type, source_line)"


# points of extension


def user_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate of the user's: lists of an even number of cells."""
    check = kernels.check_with((("even", "x y", "x = y & emp | (exists a b. x |-> a * a |-> b * even(b, y))"),))
    text = """SELECT p_partkey, concat(array_join(transform(sequence(0, CAST(p_size % 6 AS INT)), i -> concat('x', i, ' |-> x', i + 1)), ' * '), ' |- even(x0, x', p_size % 6 + 1, ')') AS formula FROM part"""
    return views.run(spark, sf_dir, text).select("p_partkey", check("formula").alias("verdict"))


QUERIES["P2_user_predicates"] = user_predicates
ORACLES["P2_user_predicates"] = "SELECT p_partkey, CASE WHEN p_size % 6 % 2 = 1 THEN 'valid' ELSE 'invalid' END AS verdict FROM part"


def user_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas that users offer are taken only if they can be proved."""
    text = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'X |-> Y * Y |-> nil => list(X)' WHEN 1 THEN 'list(X) => tree(X)' ELSE 'lsso(X, Y) * lsso(Y, Z) => lsso(X, Z)' END AS formula FROM part"""
    return views.run(spark, sf_dir, text).select("p_partkey", kernels.lemma_offer("formula").alias("taken"))


QUERIES["P3_user_lemmas"] = user_lemmas
ORACLES["P3_user_lemmas"] = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'refused' ELSE 'taken' END AS taken FROM part"


def adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage by a callable that the user gives; a failed call keeps the finding for escalation."""

    def call(row: dict) -> tuple[bool, float]:
        if row["line"] % 7 == 0:
            raise RuntimeError("no answer")
        return row["line"] % 2 == 0, row["line"] % 5 / 4

    rows = views.run(spark, sf_dir, "SELECT DISTINCT location, line, cwe FROM v_finding WHERE cwe IS NOT NULL")
    told = readers.adjudicated(rows, call, ["location", "line", "cwe"])
    drop = (~F.col("is_true_positive")) & (F.col("confidence") >= 0.75)
    escalate = F.col("confidence").isNull() | F.col("confidence").between(0.35, 0.7499)
    return told.select("location", "line", "cwe", F.when(drop, "drop").when(escalate, "escalate").otherwise("keep").alias("decision"))


QUERIES["P4_adjudicator"] = adjudicated
ORACLES["P4_adjudicator"] = "SELECT location, line, cwe, CASE WHEN line % 7 = 0 THEN 'escalate' WHEN line % 2 = 1 AND line % 5 IN (3, 4) THEN 'drop' WHEN line % 5 IN (2) THEN 'escalate' ELSE 'keep' END AS decision FROM (SELECT DISTINCT location, line, cwe FROM v_finding WHERE cwe IS NOT NULL) t"


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernels as SQL functions, and the scan as a table function."""
    kernels.register(spark)
    text = """SELECT p_partkey, concat('def f():', char(10), '    x = input()', char(10), if(p_partkey % 2 = 0, '    eval(x)', '    eval(int(x))'), char(10)) AS text, concat('a |-> b * b |-> nil |- ', if(p_size % 2 = 0, 'list(a)', 'tree(a)')) AS formula FROM part"""
    views.run(spark, sf_dir, text).createOrReplaceTempView("faultline_programs")
    return spark.sql("SELECT p_partkey, faultline_check(formula) AS verdict, s.line AS line, s.type AS type FROM faultline_programs, LATERAL faultline_scan(concat(p_partkey, '.py'), text) s")


QUERIES["P6_sql_functions"] = sql_functions
ORACLES["P6_sql_functions"] = "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'valid' ELSE 'invalid' END AS verdict, CAST(3 AS INT) AS line, 'code_injection' AS type FROM part WHERE p_partkey % 2 = 0"


# expressions


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C integer literals: decimal, hexadecimal, octal and binary, with suffixes."""
    body = "regexp_replace(lower(raw), '[ul]+$', '')"
    text = f"""SELECT p_partkey, CAST(CASE WHEN {body} LIKE '0x%' THEN conv(substr({body}, 3), 16, 10) WHEN {body} LIKE '0b%' THEN conv(substr({body}, 3), 2, 10) WHEN {body} LIKE '0%' AND length({body}) > 1 THEN conv(substr({body}, 2), 8, 10) ELSE {body} END AS BIGINT) AS value
      FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat('0x', hex(p_partkey)) WHEN 1 THEN concat('0', conv(p_partkey, 10, 8)) WHEN 2 THEN concat('0b', bin(p_partkey)) ELSE CAST(p_partkey AS STRING) END || CASE p_partkey % 3 WHEN 0 THEN 'UL' WHEN 1 THEN '' ELSE 'll' END AS raw FROM part) r"""
    return views.run(spark, sf_dir, text)


QUERIES["L13_c_literals"] = literals
ORACLES["L13_c_literals"] = "SELECT p_partkey, p_partkey AS value FROM part"


def folded_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT p_partkey, concat('(', p_size, ' * 18) + n ', CASE p_partkey % 3 WHEN 0 THEN '- 4' WHEN 1 THEN '<< 2' ELSE '% 7' END, '|n=', p_partkey) AS formula FROM part"
    return views.run(spark, sf_dir, text).select("p_partkey", kernels.folded_expression("formula").cast("long").alias("value"))


QUERIES["L12_constant_folding"] = folded_expressions
ORACLES["L12_constant_folding"] = "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size * 18 + p_partkey - 4 WHEN 1 THEN (p_size * 18 + p_partkey) * 4 ELSE p_size * 18 + p_partkey % 7 END AS BIGINT) AS value FROM part"


def expression_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names read and calls made by a line of code."""
    text = "SELECT p_partkey, concat('r = f', p_size % 3, '(a', p_partkey % 5, ', b[c.d]) + g(\"x\")') AS formula FROM part"
    return views.run(spark, sf_dir, text).select("p_partkey", kernels.reads("formula").alias("reads"))


QUERIES["L16_reads"] = expression_reads
ORACLES["L16_reads"] = "SELECT p_partkey, 'a' || CAST(p_partkey % 5 AS STRING) || ',b,c|f' || CAST(p_size % 3 AS STRING) || ',g' AS reads FROM part"

#: Inline sanitizer patterns and a text that each is met by; the kinds that a match makes safe.
SANITIZERS = (
    ("int_cast", r"\bint\(", "int(x)"),
    ("float_cast", r"\bfloat\(", "float(x)"),
    ("parse_int", r"(^|[^.\w])parseInt\(", "parseInt(x)"),
    ("number", r"\bNumber\(", "Number(x)"),
    ("integer_parse", r"Integer\.parseInt\(", "Integer.parseInt(x)"),
    ("shell_quote", r"shlex\.quote\(", "shlex.quote(x)"),
    ("html_escape", r"html\.escape\(", "html.escape(x)"),
    ("uri_component", r"encodeURIComponent\(", "encodeURIComponent(x)"),
    ("basename", r"basename\(", "os.path.basename(x)"),
    ("secure_name", r"secure_filename\(", "secure_filename(x)"),
    ("purify", r"DOMPurify\.sanitize\(", "DOMPurify.sanitize(x)"),
    ("html_encode", r"HtmlEncode\(", "HttpUtility.HtmlEncode(x)"),
    ("quote_double", r"\.replace\('\"', '\"\"'\)", "x.replace('\"', '\"\"')"),
    ("strip_tags", r"\.replace\(/<\[\^>\]\*>/g", "x.replace(/<[^>]*>/g, y)"),
    ("match_digits", r"\.isdigit\(\)", "x.isdigit()"),
    ("escape_string", r"escape_string\(", "escape_string(x)"),
    ("length", r"\.length\b", "x.length"),
)


def inline_sanitizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ", ".join(f"'{n}'" for n, _, _ in SANITIZERS)
    samples = ", ".join(cases._spark(t) for _, _, t in SANITIZERS)
    hits = ", ".join(f"if(text RLIKE {cases._spark(p)}, '{n}', NULL)" for n, p, _ in SANITIZERS)
    text = f"""SELECT p_partkey, array_join(array_sort(array_compact(array({hits}))), ',') AS sanitizers FROM (SELECT p_partkey, concat('run(', element_at(array({samples}), CAST(p_partkey % {len(SANITIZERS)} + 1 AS INT)), ', ', if(p_size % 2 = 0, 'int(y)', 'y'), ')') AS text, array({names}) AS names FROM part) t"""
    return views.run(spark, sf_dir, text)


QUERIES["L17_inline_sanitizers"] = inline_sanitizers
ORACLES["L17_inline_sanitizers"] = f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat([n.name], CASE WHEN p_size % 2 = 0 THEN ['int_cast'] ELSE [] END))), ',') AS sanitizers
  FROM part JOIN (VALUES {', '.join(f"({i}, '{n}')" for i, (n, _, _) in enumerate(SANITIZERS))}) AS n(i, name) ON p_partkey % {len(SANITIZERS)} = n.i"""


def feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks behind guards that contradict each other are not reached; a guard ends where its variable is written."""
    text = """SELECT concat('b', p_partkey, '.py') AS filename, concat('def run(n):\\n    x = input()\\n    if n > ', p_size, ':\\n', if(p_partkey % 4 = 0, '        n = other()\\n', '        pass\\n'), '        if n < ', p_partkey % 60, ':\\n            eval(x)\\n') AS text FROM part"""
    found = engine.scan(views.run(spark, sf_dir, text))
    return found.filter("error IS NULL").select(F.col("file").alias("filename"), "line", "type")


QUERIES["B11_contradictory_guards"] = feasible
ORACLES["B11_contradictory_guards"] = "SELECT 'b' || CAST(p_partkey AS STRING) || '.py' AS filename, CAST(6 AS INT) AS line, 'code_injection' AS type FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 60 - p_size >= 2"


def owner_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection that names the caller, or is followed by a check of the owner, is no finding."""
    text = """SELECT concat('o', p_partkey, '.py') AS filename, concat('def run(request):\\n    k = request.GET["k"]\\n', CASE p_partkey % 4 WHEN 0 THEN '    o = Item.objects.get(id=k)\\n' WHEN 1 THEN '    o = Item.objects.get(id=k, owner=request.user)\\n' WHEN 2 THEN '    o = Item.objects.get(id=k)\\n    if o.owner != request.user:\\n        raise E()\\n' ELSE '    o = Item.objects.get(id=7)\\n' END, '    return o\\n') AS text FROM part"""
    found = engine.scan(views.run(spark, sf_dir, text))
    return found.filter("error IS NULL").select(F.col("file").alias("filename"), "line", "type")


QUERIES["B13_owner_discharge"] = owner_checks
ORACLES["B13_owner_discharge"] = "SELECT 'o' || CAST(p_partkey AS STRING) || '.py' AS filename, CAST(3 AS INT) AS line, 'idor' AS type FROM part WHERE p_partkey % 4 = 0"
