"""Queries that need more than one statement: fixpoints and kernels over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import findings, fixpoint
from ..scan import engine
from . import views


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customer -> order -> part -> supplier: seeds, edges up to parts, edges from parts. Nodes are longs: key * 4 + layer."""
    node = lambda c, layer: (F.col(c).cast("long") * 4 + layer)
    customers = _table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"))
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    first = orders.select(node("o_custkey", 0).alias("src"), node("o_orderkey", 1).alias("dst")).unionByName(items.select(node("l_orderkey", 1).alias("src"), node("l_partkey", 2).alias("dst")))
    last = items.select(node("l_partkey", 2).alias("src"), node("l_suppkey", 3).alias("dst"))
    return customers.select(node("c_custkey", 0).alias("node")), first, last


def taint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taint reaches parts; a part that sanitizes a sink's kind passes nothing on to it; what reaches a sink is a finding."""
    seeds, first, last = _flow(spark, sf_dir)
    kinds = F.when(F.col("s_nationkey") % 3 == 0, "sql_injection").when(F.col("s_nationkey") % 3 == 1, "xss").otherwise("command_injection")
    sinks = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey").cast("long") * 4 + 3).alias("dst"), kinds.alias("type"))
    clean = _table(spark, sf_dir, "part").filter("p_size % 5 = 0").select((F.col("p_partkey").cast("long") * 4 + 2).alias("src"), F.when(F.col("p_size") % 2 == 0, "sql_injection").otherwise("xss").alias("type"))
    tainted = fixpoint.reachable(seeds, first).filter("node % 4 = 2").select(F.col("node").alias("src"))
    hits = last.distinct().join(tainted, "src", "left_semi").join(sinks, "dst").join(clean, ["src", "type"], "left_anti")
    found = hits.select(F.col("dst").alias("sink"), "type").distinct()
    vuln = spark.sql(views.with_views("SELECT type, severity, cwe FROM vuln", 0, sf_dir))
    return found.join(F.broadcast(vuln), "type", "left").groupBy("type", "cwe", "severity").agg(F.count("*").alias("findings"))


TAINT_ORACLE = """SELECT k.type, v.cwe, v.severity, count(*) AS findings FROM (SELECT DISTINCT l.l_suppkey, s.type FROM lineitem l
  JOIN (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'xss' ELSE 'command_injection' END AS type FROM supplier) s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('MACHINERY', 'BUILDING'))
  AND NOT (p.p_size % 5 = 0 AND s.type = CASE WHEN p.p_size % 2 = 0 THEN 'sql_injection' ELSE 'xss' END)) k LEFT JOIN vuln v ON k.type = v.type GROUP BY k.type, v.cwe, v.severity"""


CALLS = "SELECT DISTINCT CAST(substr(caller, 2) AS INT) AS src, CAST(substr(callee, 2) AS INT) AS dst FROM v_call"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.substring(c, 2, 10).cast("int")
    return views.run(spark, sf_dir, "SELECT caller, callee FROM v_call").select(number("caller").alias("src"), number("callee").alias("dst")).distinct()


def interprocedural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures that tainted arguments reach through calls, by the least number of calls."""
    return fixpoint.reachable(spark.range(1).select(F.lit(5).alias("node")), _calls(spark, sf_dir))


def equality_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fixpoint.components(_calls(spark, sf_dir))
    return found.groupBy(F.col("label").alias("component")).agg(F.count("*").alias("members"))


def sanitized_on_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Must-analysis over calls: facts 0..4 hold at procedure 5; procedures 0, 60 and 120 kill one each, 3 and 4 are killed nowhere."""
    calls = fixpoint._cut(_calls(spark, sf_dir))
    nodes = calls.select(F.col("src").alias("node")).unionByName(calls.select(F.col("dst").alias("node"))).distinct()
    entry = spark.range(5).select(F.lit(5).alias("node"), F.col("id").cast("int").alias("fact"))
    kills = nodes.filter("node % 60 = 0 AND node < 180").select("node", F.expr("CAST(node / 60 AS INT)").alias("fact"))
    return fixpoint.must_hold(nodes, calls, entry, kills)


def callers_of_the_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures from which a call chain leads to one of the first ten."""
    edges = _calls(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return fixpoint.reachable(spark.range(10).select(F.col("id").cast("int").alias("node")), edges).select("node")


def _heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.run(spark, sf_dir, "SELECT src, dst FROM v_heap")


def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that node 0 reaches, by the least number of steps; no path is longer than there are edges."""
    heap = _heap(spark, sf_dir)
    return fixpoint.far_reachable(spark.range(1).select(F.col("id").alias("node")), heap)


#: Steps of a heap path, as in the reference.
HEAP_DEPTH = 10


def heap_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every origin, what at most HEAP_DEPTH steps reach, by the least number of steps; a path ends where it would return to its origin."""
    heap = fixpoint._cut(_heap(spark, sf_dir))
    new = heap.select(F.col("src").alias("origin"), F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct()
    known = new
    for depth in range(2, HEAP_DEPTH + 1):
        moved = new.select("origin", F.col("node").alias("src")).join(heap, "src").filter(F.col("dst") != F.col("origin")).select("origin", F.col("dst").alias("node")).distinct()
        new = fixpoint._cut(moved.join(known, ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.unionByName(new)
    return known


def cookie_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each user over all events."""
    kind = F.col("event_type")
    flags = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(kind == "view").alias("http_only"), F.bool_or(kind == "error").alias("secure"))
    return flags.withColumn("cwe", F.when(~F.col("secure"), "CWE-614").when(~F.col("http_only"), "CWE-1004").otherwise("none"))


def sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.run(spark, sf_dir, "SELECT DISTINCT location, line, type, cwe, severity FROM v_finding WHERE cwe IS NOT NULL")
    return findings.read_sarif(findings.to_sarif(found)).groupBy("rule_id", "level").agg(F.count("*").alias("n"))


def anchored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.run(spark, sf_dir, "SELECT DISTINCT location, cwe, line FROM v_finding WHERE cwe IS NOT NULL")
    return findings.anchored_clusters(rows, ["location", "cwe"], "line", 3).groupBy("location", "cwe", "anchor").agg(F.count("*").alias("n"))


#: Truths and findings of a file and weakness within five lines.
TRUTH_PAIRS = """SELECT t.repo, t.cwe, t.location, t.line AS left_line, f.line AS right_line FROM
      (SELECT *, FDIV(line, 5) + step AS bucket FROM (SELECT DISTINCT repo, cwe, location, line FROM v_truth WHERE status = 'true_positive') x CROSS JOIN (SELECT -1 AS step UNION ALL SELECT 0 UNION ALL SELECT 1) around) t
      JOIN (SELECT *, FDIV(line, 5) AS bucket FROM (SELECT DISTINCT repo, cwe, location, line FROM v_finding) y) f
      ON t.repo = f.repo AND t.cwe = f.cwe AND t.location = f.location AND t.bucket = f.bucket AND abs(t.line - f.line) <= 5"""


def truth_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and truths one to one: of the pairs of a file and weakness within five lines, the nearest first."""
    found = findings.greedy_matches(views.run(spark, sf_dir, TRUTH_PAIRS), ["repo", "cwe", "location"])
    return found.groupBy("repo", "cwe").agg(F.count("*").alias("matched"), F.sum(F.abs(F.col("left_line") - F.col("right_line"))).alias("lines_apart"))


#: The loop itself: in each step every file takes its nearest pair whose ends are both free.
TRUTH_SQL = f"""WITH RECURSIVE near AS (SELECT *, row_number() OVER (PARTITION BY repo, cwe, location ORDER BY abs(left_line - right_line), left_line, right_line) AS n FROM ({TRUTH_PAIRS}) p),
  step AS (SELECT repo, cwe, location, min(n) AS n, [min_by(left_line, n)] AS ls, [min_by(right_line, n)] AS rs FROM near GROUP BY repo, cwe, location
    UNION ALL SELECT repo, cwe, location, min(n), list_append(any_value(ls), min_by(left_line, n)), list_append(any_value(rs), min_by(right_line, n)) FROM (SELECT s.repo, s.cwe, s.location, s.ls, s.rs, p.n, p.left_line, p.right_line FROM step s JOIN near p ON p.repo = s.repo AND p.cwe = s.cwe AND p.location = s.location AND p.n > s.n WHERE NOT list_contains(s.ls, p.left_line) AND NOT list_contains(s.rs, p.right_line)) q GROUP BY repo, cwe, location)
  SELECT s.repo, s.cwe, count(*) AS matched, ISUM(abs(p.left_line - p.right_line)) AS lines_apart FROM step s JOIN near p ON p.repo = s.repo AND p.cwe = s.cwe AND p.location = s.location AND p.n = s.n GROUP BY s.repo, s.cwe"""


FORMULAS = """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'a |-> b * b |-> nil |- ls(a, nil)' WHEN 1 THEN 'a |-> b |- a |-> c' WHEN 2 THEN 'ls(a, b) * ls(b, nil) |- ls(a, nil)'
  WHEN 3 THEN 'a |-> b * a |-> c' WHEN 4 THEN 'tree(a) |- tree(b)' ELSE 'a |-> ' END AS formula FROM part"""


def entailments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.run(spark, sf_dir, FORMULAS)
    return rows.select("p_partkey", kernels.check("formula").alias("verdict"))


def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small program for each part; every third cleans its input first."""
    rows = views.run(spark, sf_dir, "SELECT 'f' || CAST(p_partkey AS STRING) || '.py' AS filename, 'import os\ndef run():\n    a = input()\n    b = ' || CASE WHEN p_partkey % 3 = 0 THEN 'shlex.quote(a)' ELSE 'a + 1' END || '\n    os.system(b)\n' AS text FROM part")
    return engine.scan(rows).filter("error IS NULL").select("file", "line", "type", "source_line")


QUERIES: dict[str, Callable] = {
    "M2_entailment": entailments,
    "A8_python_scan": source_scan,
    "F2_taint_findings": taint_findings,
    "F4_interprocedural": interprocedural,
    "F10_equality_classes": equality_classes,
    "D14_must_hold": sanitized_on_all_paths,
    "F4_callers": callers_of_the_first,
    "F6_bfs_depth": bfs_depth,
    "F11_heap_paths": heap_paths,
    "G16_cookie_flags": cookie_flags,
    "A18_sarif_round_trip": sarif,
    "E6_anchored_clusters": anchored_clusters,
    "C5_truth_matching": truth_matches,
}

ORACLES: dict[str, str] = {
    "E6_anchored_clusters": """WITH RECURSIVE lines AS (SELECT DISTINCT location, cwe, line FROM v_finding WHERE cwe IS NOT NULL), anchors AS (SELECT location, cwe, min(line) AS anchor FROM lines GROUP BY location, cwe
      UNION ALL SELECT l.location, l.cwe, min(l.line) FROM anchors a JOIN lines l ON l.location = a.location AND l.cwe = a.cwe AND l.line > a.anchor + 3 GROUP BY l.location, l.cwe)
      SELECT a.location, a.cwe, CAST(a.anchor AS INT) AS anchor, count(*) AS n FROM anchors a JOIN lines l ON l.location = a.location AND l.cwe = a.cwe AND l.line BETWEEN a.anchor AND a.anchor + 3 GROUP BY a.location, a.cwe, a.anchor""",
    "C5_truth_matching": TRUTH_SQL,
    "F6_bfs_depth": "WITH RECURSIVE walk AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION ALL SELECT h.dst, w.depth + 1 FROM walk w JOIN v_heap h ON w.node = h.src WHERE w.depth < (SELECT count(*) FROM part)) SELECT node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY node",
    "F11_heap_paths": "WITH RECURSIVE walk AS (SELECT src AS origin, dst AS node, 1 AS depth FROM v_heap UNION ALL SELECT w.origin, h.dst, w.depth + 1 FROM walk w JOIN v_heap h ON w.node = h.src WHERE w.depth < 10 AND h.dst <> w.origin) SELECT origin, node, min(depth) AS depth FROM walk GROUP BY origin, node",
    "G16_cookie_flags": "SELECT user_id, bool_or(event_type = 'view') AS http_only, bool_or(event_type = 'error') AS secure, CASE WHEN NOT bool_or(event_type = 'error') THEN 'CWE-614' WHEN NOT bool_or(event_type = 'view') THEN 'CWE-1004' ELSE 'none' END AS cwe FROM events GROUP BY user_id",
    "M2_entailment": "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'valid' WHEN 3 THEN 'unsat' WHEN 4 THEN 'invalid' ELSE 'error' END AS verdict FROM part",
    "A8_python_scan": "SELECT 'f' || CAST(p_partkey AS STRING) || '.py' AS file, CAST(5 AS INT) AS line, 'command_injection' AS type, CAST(3 AS INT) AS source_line FROM part WHERE p_partkey % 3 <> 0",
    "F2_taint_findings": TAINT_ORACLE,
    "F4_interprocedural": f"WITH RECURSIVE edge AS ({CALLS}), walk AS (SELECT CAST(5 AS INT) AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edge e ON w.node = e.src WHERE w.depth < 64) SELECT node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY node",
    "F10_equality_classes": f"WITH RECURSIVE edge AS ({CALLS}), either AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge), walk AS (SELECT src AS node, src AS label FROM either UNION SELECT b.dst, w.label FROM walk w JOIN either b ON w.node = b.src), least AS (SELECT node, min(label) AS component FROM walk GROUP BY node) SELECT component, count(*) AS members FROM least GROUP BY component",
    "D14_must_hold": f"WITH RECURSIVE edge AS ({CALLS}), walk AS (SELECT CAST(5 AS INT) AS node UNION SELECT e.dst FROM walk w JOIN edge e ON w.node = e.src), fails AS (SELECT DISTINCT k.n AS node, CAST(k.n // 60 AS INT) AS fact FROM (SELECT src AS n FROM edge UNION SELECT dst FROM edge) k WHERE k.n % 60 = 0 AND k.n < 180 UNION SELECT e.dst, f.fact FROM fails f JOIN edge e ON f.node = e.src) SELECT w.node, CAST(k.fact AS INT) AS fact FROM walk w CROSS JOIN (SELECT unnest(range(5)) AS fact) k WHERE NOT EXISTS (SELECT 1 FROM fails f WHERE f.node = w.node AND f.fact = k.fact)",
    "F4_callers": f"WITH RECURSIVE edge AS ({CALLS}), back AS (SELECT CAST(n AS INT) AS node FROM (SELECT unnest(range(10)) AS n) k UNION SELECT e.src FROM back b JOIN edge e ON b.node = e.dst) SELECT node FROM back",
    "A18_sarif_round_trip": "SELECT cwe AS rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM (SELECT DISTINCT location, line, type, cwe, severity FROM v_finding WHERE cwe IS NOT NULL) t GROUP BY ALL",
}
