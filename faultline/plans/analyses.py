"""Analyses of whole programs by joins: facts on branching graphs, through calls, over graphs of cells. Programs come from the
views v_stmt and v_step, whose procedures branch, loop, return early and call one another, themselves included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import access_paths, constants, flow, graphs, intervals, matching, sketches, tabulation, whole_calls, whole_graphs
from . import views

#: Statements that set their target, and those that read their source.
SETS = "('source', 'const', 'copy', 'add', 'call')"
READS = "('copy', 'add', 'call', 'sink', 'branch', 'loop', 'return')"
VARIABLES = "(SELECT DISTINCT tgt AS var FROM v_stmt UNION SELECT DISTINCT src AS var FROM v_stmt)"


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return views.run(spark, sf_dir, text)


def _not_in(rows: DataFrame, column: str, other: DataFrame, of: str) -> DataFrame:
    """Rows whose column is NOT IN the other's, as SQL has it: nothing where the other holds a null. Spark makes of NOT IN a table that the driver sends whole to all; this is a join by both sides' keys."""
    nulls = other.filter(F.col(of).isNull()).agg(F.count("*").alias("_nulls"))
    away = rows.filter(F.col(column).isNotNull()).join(other.filter(F.col(of).isNotNull()).select(F.col(of).alias(column)).distinct(), column, "left_anti")
    return away.crossJoin(nulls).filter("_nulls = 0").drop("_nulls")


def _shared(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What several queries read, written by the first of them."""
    return spark.read.parquet(views.kept(spark, sf_dir, name, make, ["lineitem", "orders"]))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT proc, src, dst, label FROM v_step")


ENTRIES = "SELECT DISTINCT proc, 0 AS node FROM v_stmt"


def reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: for each read of a variable, how many definitions reach it, and whether it may, or must, still be unset (definition 0)."""
    gen = _sql(spark, sf_dir, f"SELECT proc, node, node AS fact, tgt AS part FROM v_stmt WHERE op IN {SETS}")
    unset = _sql(spark, sf_dir, f"SELECT proc, 0 AS node, 0 AS fact, var AS part FROM (SELECT DISTINCT proc FROM v_stmt) p CROSS JOIN {VARIABLES} v")
    reach = flow.flow_facts(_steps(spark, sf_dir), _sql(spark, sf_dir, ENTRIES), gen=gen, kill=gen.select("proc", "node", "part"), at_start=unset, ask="may")
    reads = _sql(spark, sf_dir, f"SELECT proc, node, src AS part FROM v_stmt WHERE op IN {READS}")
    found = reads.join(reach, ["proc", "node", "part"]).groupBy("proc", "node", F.col("part").alias("var")).agg(F.count("*").alias("definitions"), F.min("fact").alias("least"))
    return found.select("proc", "node", "var", "definitions", (F.col("least") == 0).alias("may_be_unset"), ((F.col("least") == 0) & (F.col("definitions") == 1)).alias("is_unset"))


REACHED_SQL = "reached AS (SELECT DISTINCT proc, 0 AS node FROM v_stmt UNION SELECT e.proc, e.dst FROM reached r JOIN v_step e ON e.proc = r.proc AND e.src = r.node)"

REACHING_SQL = f"""WITH RECURSIVE walk AS (SELECT p.proc, 0 AS node, v.var, 0 AS def FROM (SELECT DISTINCT proc FROM v_stmt) p CROSS JOIN {VARIABLES} v
    UNION SELECT w.proc, e.dst, w.var, CASE WHEN s.op IN {SETS} AND s.tgt = w.var THEN w.node ELSE w.def END FROM walk w JOIN v_step e ON e.proc = w.proc AND e.src = w.node LEFT JOIN v_stmt s ON s.proc = w.proc AND s.node = w.node)
  SELECT w.proc, w.node, w.var, count(*) AS definitions, min(w.def) = 0 AS may_be_unset, min(w.def) = 0 AND count(*) = 1 AS is_unset FROM walk w JOIN v_stmt r ON r.proc = w.proc AND r.node = w.node AND r.src = w.var AND r.op IN {READS} GROUP BY w.proc, w.node, w.var"""


def ownership_at_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """allocations that may, or must, still be owned where their procedure ends; freeing or setting the variable ends that."""
    gen = _sql(spark, sf_dir, "SELECT proc, node, node AS fact, tgt AS part FROM v_stmt WHERE op = 'source'")
    kill = _sql(spark, sf_dir, f"SELECT proc, node, tgt AS part FROM v_stmt WHERE op = 'free' OR op IN {SETS}")
    exits = _sql(spark, sf_dir, "SELECT DISTINCT proc, size + 1 AS node FROM v_stmt")
    steps, starts = _steps(spark, sf_dir), _sql(spark, sf_dir, ENTRIES)
    held = flow.flow_facts(steps, starts, gen=gen, kill=kill).join(exits, ["proc", "node"], "left_semi")
    return held.select("proc", F.col("fact").alias("allocated"), F.col("part").alias("var"), F.col("must").alias("on_all_paths"))


OWNERSHIP_SQL = f"""WITH RECURSIVE {REACHED_SQL},
  ends AS (SELECT proc, node, tgt AS var FROM v_stmt WHERE op = 'free' OR op IN {SETS}),
  made AS (SELECT proc, node AS fact, tgt AS var FROM v_stmt WHERE op = 'source'),
  may AS (SELECT m.proc, e.dst AS node, m.fact, m.var FROM made m JOIN reached r ON r.proc = m.proc AND r.node = m.fact JOIN v_step e ON e.proc = m.proc AND e.src = m.fact
    UNION SELECT w.proc, e.dst, w.fact, w.var FROM may w JOIN v_step e ON e.proc = w.proc AND e.src = w.node LEFT JOIN ends k ON k.proc = w.proc AND k.node = w.node AND k.var = w.var WHERE k.proc IS NULL),
  absent AS (SELECT proc, 0 AS node, fact FROM made
    UNION SELECT m.proc, e.dst, m.fact FROM made m JOIN ends k ON k.proc = m.proc AND k.var = m.var AND k.node <> m.fact JOIN reached r ON r.proc = k.proc AND r.node = k.node JOIN v_step e ON e.proc = k.proc AND e.src = k.node
    UNION SELECT a.proc, e.dst, a.fact FROM absent a JOIN v_step e ON e.proc = a.proc AND e.src = a.node WHERE a.node <> a.fact)
  SELECT w.proc, w.fact AS allocated, w.var, a.proc IS NULL AS on_all_paths FROM may w JOIN (SELECT DISTINCT proc, size + 1 AS node FROM v_stmt) x ON x.proc = w.proc AND x.node = w.node LEFT JOIN absent a ON a.proc = w.proc AND a.node = w.node AND a.fact = w.fact"""


#: Calls of these procedures do not come back.
NO_RETURN = "op = 'call' AND callee % 11 = 0"
NULL_STEPS = f"SELECT e.proc, e.src, e.dst, e.label FROM v_step e LEFT JOIN (SELECT proc, node FROM v_stmt WHERE {NO_RETURN}) n ON n.proc = e.proc AND n.node = e.src WHERE n.proc IS NULL"


def null_dereferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of a variable that may, or must, be null there. A branch on a variable narrows it on its true edge and confirms it
    on its false edge; what follows a call that does not return is not reached."""
    gen = _sql(spark, sf_dir, "SELECT proc, node, tgt AS fact, tgt AS part FROM v_stmt WHERE op = 'const' AND val % 3 = 0")
    kill = _sql(spark, sf_dir, f"SELECT proc, node, tgt AS part FROM v_stmt WHERE op IN {SETS}")
    on_edge = lambda label: _sql(spark, sf_dir, f"SELECT e.proc, e.src, e.dst, e.label, s.src AS fact, s.src AS part FROM v_step e JOIN v_stmt s ON s.proc = e.proc AND s.node = e.src WHERE s.op = 'branch' AND e.label = '{label}'")
    steps, starts = _sql(spark, sf_dir, NULL_STEPS), _sql(spark, sf_dir, ENTRIES)
    null = flow.flow_facts(steps, starts, gen=gen, kill=kill, edge_gen=on_edge("false"), edge_kill=on_edge("true").drop("fact"))
    uses = _sql(spark, sf_dir, "SELECT proc, node, src AS var FROM v_stmt WHERE op IN ('sink', 'call')")
    return uses.join(null.select("proc", "node", F.col("fact").alias("var"), F.col("must").alias("certain")), ["proc", "node", "var"])


NULL_SQL = f"""WITH RECURSIVE step AS ({NULL_STEPS}), reached AS (SELECT DISTINCT proc, 0 AS node FROM v_stmt UNION SELECT e.proc, e.dst FROM reached r JOIN step e ON e.proc = r.proc AND e.src = r.node),
  labelled AS (SELECT e.*, CASE WHEN s.op = 'branch' THEN s.src END AS tested, CASE WHEN s.op IN {SETS} THEN s.tgt END AS sets, CASE WHEN s.op = 'const' AND s.val % 3 = 0 THEN s.tgt END AS nulls FROM step e LEFT JOIN v_stmt s ON s.proc = e.proc AND s.node = e.src),
  may AS (SELECT e.proc, e.dst AS node, e.nulls AS var FROM labelled e JOIN reached r ON r.proc = e.proc AND r.node = e.src WHERE e.nulls IS NOT NULL
    UNION SELECT e.proc, e.dst, e.tested FROM labelled e JOIN reached r ON r.proc = e.proc AND r.node = e.src WHERE e.tested IS NOT NULL AND e.label = 'false'
    UNION SELECT w.proc, e.dst, w.var FROM may w JOIN labelled e ON e.proc = w.proc AND e.src = w.node WHERE (e.sets IS NULL OR e.sets <> w.var) AND NOT (e.tested IS NOT NULL AND e.tested = w.var AND e.label = 'true')),
  absent AS (SELECT p.proc, 0 AS node, v.var FROM (SELECT DISTINCT proc FROM v_stmt) p CROSS JOIN {VARIABLES} v
    UNION SELECT e.proc, e.dst, e.sets FROM labelled e JOIN reached r ON r.proc = e.proc AND r.node = e.src WHERE e.sets IS NOT NULL AND e.nulls IS NULL
    UNION SELECT e.proc, e.dst, e.tested FROM labelled e JOIN reached r ON r.proc = e.proc AND r.node = e.src WHERE e.tested IS NOT NULL AND e.label = 'true'
    UNION SELECT w.proc, e.dst, w.var FROM absent w JOIN labelled e ON e.proc = w.proc AND e.src = w.node WHERE (e.nulls IS NULL OR e.nulls <> w.var) AND NOT (e.tested IS NOT NULL AND e.tested = w.var AND e.label = 'false'))
  SELECT u.proc, u.node, u.src AS var, a.proc IS NULL AS certain FROM v_stmt u JOIN may m ON m.proc = u.proc AND m.node = u.node AND m.var = u.src LEFT JOIN absent a ON a.proc = u.proc AND a.node = u.node AND a.var = u.src WHERE u.op IN ('sink', 'call')"""


def _dominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir, "dominators", lambda: flow.dominators(_steps(spark, sf_dir), _sql(spark, sf_dir, ENTRIES)))


def dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many nodes dominate each node, itself included, and the nearest of the others."""
    above = _dominated(spark, sf_dir)
    depth = above.groupBy("proc", "node").agg(F.count("*").alias("dominators"))
    near = above.filter("node <> by").join(depth.select("proc", F.col("node").alias("by"), F.col("dominators").alias("d")), ["proc", "by"])
    nearest = near.groupBy("proc", "node").agg(F.max_by("by", "d").alias("nearest"))
    return depth.join(nearest, ["proc", "node"], "left")


#: Nodes reached with one node taken out: what is not reached then, is dominated by it.
WITHOUT_SQL = """nodes AS (SELECT proc, node FROM reached), without AS (SELECT proc, node AS gone, 0 AS node FROM nodes WHERE node <> 0
    UNION SELECT w.proc, w.gone, e.dst FROM without w JOIN v_step e ON e.proc = w.proc AND e.src = w.node WHERE e.dst <> w.gone)"""

DOMINATORS_SQL = f"""WITH RECURSIVE {REACHED_SQL}, {WITHOUT_SQL},
  above AS (SELECT n.proc, n.node, g.node AS by FROM nodes n JOIN nodes g ON n.proc = g.proc WHERE g.node = 0 OR NOT EXISTS (SELECT 1 FROM without w WHERE w.proc = n.proc AND w.gone = g.node AND w.node = n.node)),
  depth AS (SELECT proc, node, count(*) AS dominators FROM above GROUP BY proc, node)
  SELECT d.proc, d.node, d.dominators, max_by(a.by, b.dominators) AS nearest FROM depth d LEFT JOIN above a ON a.proc = d.proc AND a.node = d.node AND a.by <> d.node LEFT JOIN depth b ON b.proc = a.proc AND b.node = a.by GROUP BY d.proc, d.node, d.dominators"""

#: Calls that count as calls of the procedure itself, and procedures that handle exceptions, where nothing is said.
SELF_CALL = "op = 'call' AND callee % 3 = proc % 3"
HANDLERS = "SELECT proc FROM v_stmt WHERE op = 'return' AND val % 5 = 0"


def uncontrolled_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a procedure by itself that every way to its exit passes."""
    above = _dominated(spark, sf_dir).withColumnRenamed("node", "exit").withColumnRenamed("by", "node")
    calls = _sql(spark, sf_dir, f"SELECT proc, node, size + 1 AS exit FROM v_stmt WHERE {SELF_CALL}").join(_sql(spark, sf_dir, HANDLERS), "proc", "left_anti")
    return calls.join(above, ["proc", "node", "exit"], "left_semi").select("proc", "node")


RECURSION_SQL = f"""WITH RECURSIVE {REACHED_SQL}, {WITHOUT_SQL}
  SELECT s.proc, s.node FROM v_stmt s JOIN reached r ON r.proc = s.proc AND r.node = s.node WHERE {SELF_CALL.replace("op", "s.op").replace("callee", "s.callee").replace("= proc", "= s.proc")} AND s.proc NOT IN ({HANDLERS})
    AND NOT EXISTS (SELECT 1 FROM without w WHERE w.proc = s.proc AND w.gone = s.node AND w.node = s.size + 1)"""


FLAT = "SELECT proc * 1000000 + src AS src, proc * 1000000 + dst AS dst FROM v_step"


def flow_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the nodes of each procedure in an order that puts a node after all that lead to it, but for loops, whose nodes stand together."""
    got = graphs.levels(_sql(spark, sf_dir, FLAT))
    proc, node, part = F.expr("node div 1000000").alias("proc"), F.expr("CAST(node % 1000000 AS INT)").alias("node"), F.expr("CAST(component % 1000000 AS INT)").alias("component")
    flat = got.select(proc, node, part, "level")
    return flat.withColumn("position", F.row_number().over(Window.partitionBy("proc").orderBy("level", "component", "node")))


ORDER_SQL = """WITH RECURSIVE step AS (SELECT DISTINCT proc, src, dst FROM v_step), far AS (SELECT proc, src, dst FROM step UNION SELECT f.proc, f.src, s.dst FROM far f JOIN step s ON s.proc = f.proc AND s.src = f.dst),
  nodes AS (SELECT proc, src AS node FROM step UNION SELECT proc, dst FROM step),
  parts AS (SELECT n.proc, n.node, greatest(n.node, max(CASE WHEN b.proc IS NOT NULL THEN f.dst END)) AS component FROM nodes n LEFT JOIN far f ON f.proc = n.proc AND f.src = n.node LEFT JOIN far b ON b.proc = f.proc AND b.src = f.dst AND b.dst = f.src GROUP BY n.proc, n.node),
  links AS (SELECT DISTINCT s.proc, a.component AS src, b.component AS dst FROM step s JOIN parts a ON a.proc = s.proc AND a.node = s.src JOIN parts b ON b.proc = s.proc AND b.node = s.dst WHERE a.component <> b.component),
  deep AS (SELECT DISTINCT proc, component, 0 AS level FROM parts UNION SELECT d.proc, l.dst, d.level + 1 FROM deep d JOIN links l ON l.proc = d.proc AND l.src = d.component),
  longest AS (SELECT proc, component, CAST(max(level) AS INT) AS level FROM deep GROUP BY proc, component)
  SELECT p.proc, p.node, p.component, l.level, row_number() OVER (PARTITION BY p.proc ORDER BY l.level, p.component, p.node) AS position FROM parts p JOIN longest l ON l.proc = p.proc AND l.component = p.component"""


#: Facts of a procedure: a variable holds what is followed; NOTHING always holds, and sources make more of it; FREED: what was followed is freed.
NOTHING, FREED, ARGUMENT, RETURNED = -1, 9, 0, 1
EXITS = "SELECT DISTINCT proc, size + 1 AS node FROM v_stmt"

#: Steps inside procedures, over calls too (where the target is set anew).
TAINT_STEPS = f"""SELECT e.proc, e.src AS node, f.fact, e.dst AS to_node, f.fact AS to_fact FROM v_step e CROSS JOIN (VALUES ({NOTHING}), (0), (1), (2), (3), ({FREED})) AS f(fact) LEFT JOIN v_stmt s ON s.proc = e.proc AND s.node = e.src WHERE s.proc IS NULL OR NOT (s.op IN {SETS} AND s.tgt = f.fact)
    UNION ALL SELECT e.proc, e.src, s.src, e.dst, s.tgt FROM v_step e JOIN v_stmt s ON s.proc = e.proc AND s.node = e.src WHERE s.op IN ('copy', 'add')
    UNION ALL SELECT e.proc, e.src, {NOTHING}, e.dst, s.tgt FROM v_step e JOIN v_stmt s ON s.proc = e.proc AND s.node = e.src WHERE s.op = 'source'
    UNION ALL SELECT e.proc, e.src, s.tgt, e.dst, {FREED} FROM v_step e JOIN v_stmt s ON s.proc = e.proc AND s.node = e.src WHERE s.op = 'free'"""
CALLED = f"""SELECT s.proc, s.node, s.fact, s.callee, 0 AS entry, s.entry_fact FROM (SELECT proc, node, callee, src AS fact, {ARGUMENT} AS entry_fact FROM v_stmt WHERE op = 'call' UNION ALL SELECT proc, node, callee, {NOTHING}, {NOTHING} FROM v_stmt WHERE op = 'call') s JOIN ({EXITS}) x ON x.proc = s.callee"""
RETURNING = f"""SELECT s.proc, s.node, s.callee, x.node AS exit, f.exit_fact, e.dst AS to_node, CASE WHEN f.exit_fact = {RETURNED} THEN s.tgt ELSE f.exit_fact END AS to_fact
    FROM v_stmt s JOIN ({EXITS}) x ON x.proc = s.callee JOIN v_step e ON e.proc = s.proc AND e.src = s.node CROSS JOIN (VALUES ({RETURNED}), ({FREED})) AS f(exit_fact) WHERE s.op = 'call'"""
UNCALLED = f"SELECT DISTINCT proc, 0 AS node, {NOTHING} AS fact FROM v_stmt WHERE proc NOT IN (SELECT callee FROM v_stmt WHERE op = 'call')"
EACH_PROC = f"SELECT p.proc, 0 AS node, f.fact FROM (SELECT DISTINCT proc FROM v_stmt) p CROSS JOIN (VALUES ({NOTHING}), ({ARGUMENT})) AS f(fact)"


def _tabulated(spark: SparkSession, sf_dir: str, starts: str | DataFrame, tell: DataFrame) -> DataFrame:
    starts = _sql(spark, sf_dir, starts) if isinstance(starts, str) else starts
    return tabulation.tabulate(*(_sql(spark, sf_dir, x) for x in (TAINT_STEPS, CALLED, RETURNING)), starts, tell)


STATEMENTS = "SELECT proc, node, size, op, tgt, src, val, callee FROM v_stmt"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """What every procedure makes of nothing and of its argument, as bits; None where the statements are not of that form."""
    statements = _sql(spark, sf_dir, STATEMENTS)
    return _shared(spark, sf_dir, "states", lambda: whole_calls.states(statements)) if whole_calls.fits(statements) else None


def matched_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sinks that a source reaches from a procedure that none calls, every call returning to where it was made."""
    called = _sql(spark, sf_dir, "SELECT callee FROM v_stmt WHERE op = 'call'")
    uncalled = _not_in(_sql(spark, sf_dir, "SELECT DISTINCT proc FROM v_stmt"), "proc", called, "callee").select("proc", F.lit(0).alias("node"), F.lit(NOTHING).alias("fact"))
    sinks = _sql(spark, sf_dir, "SELECT proc, node, src AS fact FROM v_stmt WHERE op = 'sink'")
    if (held := _states(spark, sf_dir)) is not None:
        return whole_calls.reached_sinks(_sql(spark, sf_dir, STATEMENTS), held, uncalled)
    paths = _tabulated(spark, sf_dir, uncalled, sinks)
    return sinks.join(paths, ["proc", "node", "fact"]).select("proc", "node", F.col("fact").alias("var")).distinct()


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(proc, given, fact): what every procedure makes of its argument, and of nothing."""
    if (held := _states(spark, sf_dir)) is not None:
        bits = [(NOTHING, NOTHING, 0), (NOTHING, RETURNED, whole_calls.RETURNED), (ARGUMENT, RETURNED, whole_calls.ENTERED + whole_calls.RETURNED), (ARGUMENT, FREED, whole_calls.ENTERED + whole_calls.FREED)]
        facts = ", ".join(f"IF(held & {1 << bit} <> 0, struct({given} AS given, {fact} AS fact), NULL)" for given, fact, bit in bits)
        return held.select("proc", F.explode(F.expr(f"filter(array({facts}), x -> x IS NOT NULL)")).alias("x")).select("proc", "x.given", "x.fact")
    tell = _sql(spark, sf_dir, f"SELECT x.proc, x.node, f.fact FROM ({EXITS}) x CROSS JOIN (VALUES ({NOTHING}), (0), (1), (2), (3), ({FREED})) AS f(fact)")
    return _shared(spark, sf_dir, "summaries", lambda: tabulation.summaries(_tabulated(spark, sf_dir, EACH_PROC, tell), _sql(spark, sf_dir, EXITS)))


def procedure_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each procedure, whether it may return its argument, free it, or return what a source gave, through any calls."""
    ends = _summaries(spark, sf_dir)
    case = lambda given, fact: F.coalesce(F.bool_or((F.col("given") == given) & (F.col("fact") == fact)), F.lit(False))
    return ends.groupBy("proc").agg(case(ARGUMENT, RETURNED).alias("returns_argument"), case(ARGUMENT, FREED).alias("frees_argument"), case(NOTHING, RETURNED).alias("returns_source"))


def freeing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: calls whose argument the callee frees, itself or through any calls, in any order of the procedures."""
    frees = _summaries(spark, sf_dir).filter((F.col("given") == ARGUMENT) & (F.col("fact") == FREED))
    calls = _sql(spark, sf_dir, "SELECT proc, node, callee, src AS var FROM v_stmt WHERE op = 'call'")
    return calls.join(frees.select(F.col("proc").alias("callee")), "callee").select("proc", "node", "callee", "var")


def _tabulated_sql(starts: str) -> str:
    """The rule of matched calls over the whole table of paths so far, each pair from the side that is new."""
    return f"""WITH RECURSIVE flow AS ({TAINT_STEPS}), calls AS ({CALLED}), returns AS ({RETURNING}), exits AS ({EXITS}),
  path(proc, given, node, fact) USING KEY (proc, given, node, fact) AS (SELECT proc, fact AS given, node, fact FROM ({starts}) s UNION (
    SELECT p.proc, p.given, f.to_node, f.to_fact FROM path p JOIN flow f ON f.proc = p.proc AND f.node = p.node AND f.fact = p.fact
    UNION SELECT c.callee, c.entry_fact, c.entry, c.entry_fact FROM path p JOIN calls c ON c.proc = p.proc AND c.node = p.node AND c.fact = p.fact
    UNION SELECT p.proc, p.given, r.to_node, r.to_fact FROM path p JOIN calls c ON c.proc = p.proc AND c.node = p.node AND c.fact = p.fact JOIN recurring.path q ON q.proc = c.callee AND q.given = c.entry_fact JOIN returns r ON r.proc = p.proc AND r.node = p.node AND r.exit = q.node AND r.exit_fact = q.fact
    UNION SELECT p.proc, p.given, r.to_node, r.to_fact FROM path q JOIN returns r ON r.callee = q.proc AND r.exit = q.node AND r.exit_fact = q.fact JOIN calls c ON c.proc = r.proc AND c.node = r.node AND c.entry_fact = q.given JOIN recurring.path p ON p.proc = c.proc AND p.node = c.node AND p.fact = c.fact))"""


MATCHED_SQL = f"{_tabulated_sql(UNCALLED)} SELECT DISTINCT s.proc, s.node, s.src AS var FROM v_stmt s JOIN path p ON p.proc = s.proc AND p.node = s.node AND p.fact = s.src WHERE s.op = 'sink'"
SUMMARIES_SQL = f"""{_tabulated_sql(EACH_PROC)} SELECT p.proc, bool_or(p.given = {ARGUMENT} AND p.fact = {RETURNED}) AS returns_argument, bool_or(p.given = {ARGUMENT} AND p.fact = {FREED}) AS frees_argument, bool_or(p.given = {NOTHING} AND p.fact = {RETURNED}) AS returns_source
  FROM path p JOIN exits x ON x.proc = p.proc AND x.node = p.node GROUP BY p.proc"""
FREEING_SQL = f"""{_tabulated_sql(EACH_PROC)} SELECT s.proc, s.node, s.callee, s.src AS var FROM v_stmt s WHERE s.op = 'call' AND s.callee IN (SELECT p.proc FROM path p JOIN exits x ON x.proc = p.proc AND x.node = p.node WHERE p.given = {ARGUMENT} AND p.fact = {FREED})"""


#: Cells of heaps with two selectors each.
CELLS = "SELECT cell AS src, next AS dst FROM v_cell UNION ALL SELECT cell, prev FROM v_cell"
FIRST_CELLS = "SELECT cell AS node FROM v_cell WHERE cell % 1000000 = 1"
#: The same, a row a cell, and the heap that a cell is of.
LINKED, HEAP = "SELECT cell AS node, array(next, prev) AS next FROM v_cell", "{0} div 1000000"


def strong_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the strongly connected part of each cell, named by its largest cell."""
    return whole_graphs.strong_components(_sql(spark, sf_dir, LINKED), HEAP).select(F.col("node").alias("cell"), "component")


FAR = f"link AS (SELECT DISTINCT src, dst FROM ({CELLS}) c), far AS (SELECT src, dst FROM link UNION SELECT f.src, l.dst FROM far f JOIN link l ON l.src = f.dst)"
STRONG_SQL = f"WITH RECURSIVE {FAR} SELECT c.cell, greatest(c.cell, max(b.src)) AS component FROM v_cell c LEFT JOIN far f ON f.src = c.cell LEFT JOIN far b ON b.src = f.dst AND b.dst = c.cell GROUP BY c.cell"


def heap_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every cycle of cells, once, from its least cell on."""
    return whole_graphs.cycles(_sql(spark, sf_dir, LINKED), HEAP).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"), F.size("path").alias("cells"))


CYCLES_SQL = f"""WITH RECURSIVE link AS (SELECT DISTINCT src, dst FROM ({CELLS}) c), way AS (SELECT DISTINCT src AS start, src AS node, [src] AS path FROM link
    UNION ALL SELECT w.start, l.dst, list_append(w.path, l.dst) FROM way w JOIN link l ON l.src = w.node WHERE l.dst > w.start AND NOT list_contains(w.path, l.dst))
  SELECT array_to_string(w.path, '>') AS cycle, CAST(len(w.path) AS INT) AS cells FROM way w JOIN link l ON l.src = w.node AND l.dst = w.start"""


def heap_simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all ways from a heap's first cell to each of its cells that pass no cell twice: how many, the shortest and the longest."""
    paths = graphs.simple_paths(_sql(spark, sf_dir, FIRST_CELLS), _sql(spark, sf_dir, CELLS))
    steps = (F.size("path") - 1).alias("steps")
    return paths.select(F.col("node").alias("cell"), steps).groupBy("cell").agg(F.count("*").alias("paths"), F.min("steps").alias("shortest"), F.max("steps").alias("longest"))


PATHS_SQL = f"""WITH RECURSIVE link AS (SELECT DISTINCT src, dst FROM ({CELLS}) c), way AS (SELECT node, [node] AS path FROM ({FIRST_CELLS}) f
    UNION ALL SELECT l.dst, list_append(w.path, l.dst) FROM way w JOIN link l ON l.src = w.node WHERE NOT list_contains(w.path, l.dst))
  SELECT node AS cell, count(*) AS paths, CAST(min(len(path)) - 1 AS INT) AS shortest, CAST(max(len(path)) - 1 AS INT) AS longest FROM way GROUP BY node"""


def heap_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells that chains of next from two or more chain heads share, with the number of heads and the least of them. A head is a cell that no next leads to."""
    chain = _sql(spark, sf_dir, "SELECT cell AS src, next AS dst FROM v_cell")
    heads = _not_in(_sql(spark, sf_dir, "SELECT cell FROM v_cell"), "cell", _sql(spark, sf_dir, "SELECT next FROM v_cell"), "next").select(F.col("cell").alias("node"), F.col("cell").alias("head"))
    found = graphs.reachable(heads, chain, ["head"])
    return found.groupBy(F.col("node").alias("cell")).agg(F.count("*").alias("heads"), F.min("head").alias("first_head")).filter("heads > 1")


OVERLAPS_SQL = """WITH RECURSIVE way AS (SELECT cell AS node, cell AS head FROM v_cell WHERE cell NOT IN (SELECT next FROM v_cell) UNION SELECT c.next, w.head FROM way w JOIN v_cell c ON c.cell = w.node)
  SELECT node AS cell, count(*) AS heads, min(head) AS first_head FROM way GROUP BY node HAVING count(*) > 1"""

DOUBLY_LINKED = "SELECT a.cell, a.next, b.prev = a.cell AS doubly_linked FROM v_cell a JOIN v_cell b ON b.cell = a.next"


#: Constants: an argument may be anything, other variables begin as 0; what is read or returned by a call may be anything.
SETTING = """SELECT proc, node, tgt AS var, CASE WHEN op IN ('copy', 'add') THEN src END AS left, CASE WHEN op = 'add' AND val % 4 = 0 THEN tgt END AS right,
    CASE WHEN op = 'const' THEN val % 3 WHEN op = 'copy' THEN 0 WHEN op = 'add' THEN val % 5 - 2 END AS plus FROM v_stmt WHERE op IN ('source', 'const', 'copy', 'add', 'call')"""
TESTING = "SELECT proc, node, src AS var, val % 3 AS least FROM v_stmt WHERE op IN ('branch', 'loop')"
BEGINNING = f"SELECT p.proc, 0 AS node, v.var, CASE WHEN v.var = {ARGUMENT} THEN NULL ELSE 0 END AS value FROM (SELECT DISTINCT proc FROM v_stmt) p CROSS JOIN {VARIABLES} v"


def _constants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Values and open edges, found together."""

    def make() -> DataFrame:
        return constants.solved(_steps(spark, sf_dir), *(_sql(spark, sf_dir, x) for x in (ENTRIES, SETTING, TESTING, BEGINNING)))

    both = _shared(spark, sf_dir, "constants", make)
    return both.filter("node IS NOT NULL").select("proc", "node", "var", "value"), both.filter("src IS NOT NULL").select("proc", "src", "dst", "label")


def constant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variables that have one value where a node begins."""
    return _constants(spark, sf_dir)[0].filter("value IS NOT NULL")


def dead_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are never taken, and whether their node is reached at all."""
    values, opened = _constants(spark, sf_dir)
    reached = values.select("proc", F.col("node").alias("src")).distinct().withColumn("reached", F.lit(True))
    dead = _steps(spark, sf_dir).distinct().join(opened, ["proc", "src", "dst", "label"], "left_anti")
    return dead.join(reached, ["proc", "src"], "left").select("proc", "src", "dst", "label", F.coalesce("reached", F.lit(False)).alias("reached"))


def zero_divisors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks that divide by a variable that is 0 on every way that can be taken."""
    uses = _sql(spark, sf_dir, "SELECT proc, node, src AS var FROM v_stmt WHERE op = 'sink'")
    return uses.join(_constants(spark, sf_dir)[0].filter("value = 0"), ["proc", "node", "var"]).select("proc", "node", "var")


CONSTANTS_SQL = f"""WITH RECURSIVE sets AS ({SETTING}), tests AS ({TESTING}),
  v(proc, node, var, value) USING KEY (proc, node, var) AS (SELECT proc, node, var, CAST(value AS BIGINT) AS value FROM ({BEGINNING}) b UNION (
    SELECT c.proc, c.node, c.var, CASE WHEN h.proc IS NULL THEN c.value END AS value FROM (
      SELECT o.proc, e.dst AS node, o.var, CASE WHEN count(o.value) = count(*) AND min(o.value) = max(o.value) THEN min(o.value) END AS value FROM (
        SELECT r.proc, r.node, r.var, CASE WHEN s.proc IS NULL THEN r.value ELSE s.plus + CASE WHEN s.left IS NULL THEN 0 ELSE a.value END + CASE WHEN s.right IS NULL THEN 0 ELSE b.value END END AS value
        FROM (SELECT DISTINCT proc, node FROM v) d JOIN recurring.v r ON r.proc = d.proc AND r.node = d.node LEFT JOIN sets s ON s.proc = r.proc AND s.node = r.node AND s.var = r.var
          LEFT JOIN recurring.v a ON a.proc = r.proc AND a.node = r.node AND a.var = s.left LEFT JOIN recurring.v b ON b.proc = r.proc AND b.node = r.node AND b.var = s.right) o
      JOIN v_step e ON e.proc = o.proc AND e.src = o.node LEFT JOIN tests t ON t.proc = e.proc AND t.node = e.src LEFT JOIN recurring.v x ON x.proc = t.proc AND x.node = t.node AND x.var = t.var
      WHERE x.value IS NULL OR e.label = CASE WHEN x.value >= t.least THEN 'true' ELSE 'false' END GROUP BY o.proc, e.dst, o.var) c
    LEFT JOIN recurring.v h ON h.proc = c.proc AND h.node = c.node AND h.var = c.var WHERE h.proc IS NULL OR (h.value IS NOT NULL AND (c.value IS NULL OR c.value <> h.value))))"""
VALUES_SQL = f"{CONSTANTS_SQL} SELECT proc, node, var, value FROM v WHERE value IS NOT NULL"
DEAD_SQL = f"""{CONSTANTS_SQL} SELECT DISTINCT e.proc, e.src, e.dst, e.label, r.proc IS NOT NULL AS reached FROM v_step e LEFT JOIN (SELECT DISTINCT proc, node FROM v) r ON r.proc = e.proc AND r.node = e.src LEFT JOIN tests t ON t.proc = e.proc AND t.node = e.src
  LEFT JOIN v x ON x.proc = t.proc AND x.node = t.node AND x.var = t.var WHERE r.proc IS NULL OR (x.value IS NOT NULL AND e.label <> CASE WHEN x.value >= t.least THEN 'true' ELSE 'false' END)"""
ZERO_SQL = f"{CONSTANTS_SQL} SELECT s.proc, s.node, s.src AS var FROM v_stmt s JOIN v ON v.proc = s.proc AND v.node = s.node AND v.var = s.src WHERE s.op = 'sink' AND v.value = 0"


#: Findings and truths of one repository and weakness; a truth's path may lack the first folders, or have others.
FOUND = "SELECT DISTINCT repo, cwe, location AS path, line FROM v_finding WHERE cwe IS NOT NULL"
TRUTHS = """SELECT DISTINCT repo, cwe, CASE (line + length(location)) % 3 WHEN 0 THEN location WHEN 1 THEN substr(location, 5) ELSE 'checkout/' || BASENAME(location) END AS path, line FROM v_truth WHERE status = 'true_positive'"""
#: Truths and findings within five lines whose paths are equal, or one the end of the other, or whose files have one name.
NEAR = f"""SELECT t.repo, t.cwe, t.file, t.path AS t_path, t.line AS t_line, f.path AS f_path, f.line AS f_line, abs(t.line - f.line) AS gap, CASE WHEN t.path = f.path THEN 0 WHEN ENDSIN(t.path, f.path) OR ENDSIN(f.path, t.path) THEN 1 ELSE 2 END AS kind
    FROM (SELECT *, FDIV(line, 5) + step AS bucket FROM (SELECT *, BASENAME(path) AS file FROM ({TRUTHS}) x) x CROSS JOIN (VALUES (-1), (0), (1)) AS a(step)) t
    JOIN (SELECT *, FDIV(line, 5) AS bucket FROM (SELECT *, BASENAME(path) AS file FROM ({FOUND}) y) y) f ON t.repo = f.repo AND t.cwe = f.cwe AND t.file = f.file AND t.bucket = f.bucket AND abs(t.line - f.line) <= 5"""


def _greedy(spark: SparkSession, sf_dir: str, rank: list[str]) -> DataFrame:
    pairs = _sql(spark, sf_dir, NEAR)
    end = lambda c: F.struct(F.col(f"{c}_path").alias("path"), F.col(f"{c}_line").alias("line"))
    best = matching.one_to_one(pairs.select("repo", "cwe", "file", end("f").alias("left"), end("t").alias("right"), *rank), ["repo", "cwe", "file"], rank)
    return best.select("repo", "cwe", F.col("left.path").alias("f_path"), F.col("left.line").alias("f_line"), F.col("right.path").alias("t_path"), F.col("right.line").alias("t_line"))


def nearest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and truths one to one, of the pairs of a repository, weakness and file name the best path first, then the nearest line."""
    return _greedy(spark, sf_dir, ["kind", "gap"])


def ordered_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a loop over findings in order would match them, each with the first truth that is left."""
    return _greedy(spark, sf_dir, [])


def _greedy_sql(order: str) -> str:
    """The loop itself: in each step every key takes its best pair whose ends are both free."""
    return f"""WITH RECURSIVE near AS (SELECT repo, cwe, file, {{'a': f_path, 'b': f_line}} AS l, {{'a': t_path, 'b': t_line}} AS r, row_number() OVER (PARTITION BY repo, cwe, file ORDER BY {order} f_path, f_line, t_path, t_line) AS n FROM ({NEAR}) p),
  step AS (SELECT repo, cwe, file, min(n) AS n, [min_by(l, n)] AS ls, [min_by(r, n)] AS rs FROM near GROUP BY repo, cwe, file
    UNION ALL SELECT repo, cwe, file, min(n), list_append(any_value(ls), min_by(l, n)), list_append(any_value(rs), min_by(r, n)) FROM (SELECT s.repo, s.cwe, s.file, s.ls, s.rs, p.n, p.l, p.r FROM step s JOIN near p ON p.repo = s.repo AND p.cwe = s.cwe AND p.file = s.file AND p.n > s.n WHERE NOT list_contains(s.ls, p.l) AND NOT list_contains(s.rs, p.r)) q GROUP BY repo, cwe, file)
  SELECT s.repo, s.cwe, p.l.a AS f_path, p.l.b AS f_line, p.r.a AS t_path, p.r.b AS t_line FROM step s JOIN near p ON p.repo = s.repo AND p.cwe = s.cwe AND p.file = s.file AND p.n = s.n"""


#: Folds proposed for a heap: runs of its cells; the longer goes first, then the one that begins first.
FOLDS = "SELECT proc AS heap, node AS first, CAST(least(node + val % 3, size) AS INT) AS last FROM v_stmt WHERE op <> 'return'"


def disjoint_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: of the folds of all heaps those that a greedy choice takes, no cell in two of them."""
    wants = _sql(spark, sf_dir, FOLDS).select(F.struct("heap", "first", "last").alias("proposal"), F.struct((F.col("first") - F.col("last")).alias("short"), "first").alias("rank"), F.explode(F.sequence("first", "last")).alias("cell"))
    return matching.greedy_disjoint(wants.select("proposal", "rank", F.struct("proposal.heap", "cell").alias("thing"))).select("proposal.*")


FOLDS_SQL = f"""WITH RECURSIVE fold AS (SELECT heap, first, last, row_number() OVER (PARTITION BY heap ORDER BY last - first DESC, first) AS n FROM ({FOLDS}) f),
  step AS (SELECT heap, CAST(1 AS BIGINT) AS n, range(CAST(min_by(first, n) AS BIGINT), CAST(min_by(last, n) + 1 AS BIGINT)) AS used FROM fold GROUP BY heap
    UNION ALL SELECT heap, min(n), list_concat(any_value(used), range(CAST(min_by(first, n) AS BIGINT), CAST(min_by(last, n) + 1 AS BIGINT))) FROM (SELECT s.heap, s.used, f.n, f.first, f.last FROM step s JOIN fold f ON f.heap = s.heap AND f.n > s.n WHERE NOT list_has_any(s.used, range(CAST(f.first AS BIGINT), CAST(f.last + 1 AS BIGINT)))) q GROUP BY heap)
  SELECT f.heap, f.first, f.last FROM step s JOIN fold f ON f.heap = s.heap AND f.n = s.n"""


#: Cases: spans of lines of any length, and the weaknesses that count for them.
CASES = "SELECT location, min(line) AS start_line, max(line) AS stop_line, max(line + conf) % 4 AS accepts FROM v_finding GROUP BY location, proc"
ACCEPTED = "((accepts = 0 AND cwe IN ('CWE-89', 'CWE-22')) OR (accepts = 1 AND cwe IN ('CWE-79', 'CWE-78')) OR (accepts = 2 AND cwe = 'CWE-416') OR (accepts = 3 AND cwe IS NOT NULL))"
HITS = "SELECT DISTINCT location, line, cwe FROM v_finding WHERE cwe IS NOT NULL"


def case_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings within ten lines of each case whose weakness the case accepts."""
    cases = _sql(spark, sf_dir, f"SELECT *, start_line - 10 AS lo, stop_line + 10 AS hi FROM (SELECT DISTINCT * FROM ({CASES}) c) d")
    hits = _sql(spark, sf_dir, f"SELECT location, cwe, line, line AS at FROM ({HITS}) f")
    found = intervals.overlap_join(cases, hits, ["location"], ("lo", "hi"), ("line", "at")).filter(ACCEPTED)
    return found.groupBy("location", "start_line", "stop_line", "accepts").agg(F.count("*").alias("hits"), F.min("line").alias("first_hit"))


CASES_SQL = f"SELECT c.location, c.start_line, c.stop_line, c.accepts, count(*) AS hits, min(h.line) AS first_hit FROM (SELECT DISTINCT * FROM ({CASES}) x) c JOIN ({HITS}) h ON h.location = c.location AND h.line BETWEEN c.start_line - 10 AND c.stop_line + 10 AND {ACCEPTED} GROUP BY c.location, c.start_line, c.stop_line, c.accepts"

#: Longer procedures, a part each: variables begin, loops guard them by a bound over a span of statements, they go up by one, and index arrays.
PART_STMT = """SELECT l_partkey AS proc, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS INT) AS node, CAST(l_suppkey % 3 AS INT) AS var, CAST(l_quantity AS INT) AS val,
    CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'begin' WHEN 1 THEN 'loop' WHEN 2 THEN 'up' WHEN 3 THEN 'index' ELSE 'other' END AS op FROM lineitem"""
LOOPS = f"SELECT g.proc, g.var, g.node AS lo, g.node + g.val % 24 AS hi, g.val AS bound, max(i.node) AS begun FROM ({PART_STMT}) g JOIN ({PART_STMT}) i ON i.proc = g.proc AND i.var = g.var AND i.op = 'begin' AND i.node < g.node WHERE g.op = 'loop' GROUP BY g.proc, g.var, g.node, g.val"
ROOM = 12


def loop_overflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of a variable as an index inside a loop that begins it with a constant, lets it go up by one, and guards it by more than the array holds."""
    loops = _sql(spark, sf_dir, LOOPS)
    at = lambda op, name: _sql(spark, sf_dir, f"SELECT proc, var, node AS {name}, node AS {name}_end, val AS {name}_val FROM ({PART_STMT}) s WHERE op = '{op}'")
    counted = intervals.overlap_join(loops, at("up", "up"), ["proc", "var"], ("lo", "hi"), ("up", "up_end"), "left_semi")
    used = intervals.overlap_join(counted, at("index", "used"), ["proc", "var"], ("lo", "hi"), ("used", "used_end"))
    return used.withColumn("room", F.col("used_val") % ROOM + 1).filter("bound > room").select("proc", "var", F.col("lo").alias("loop"), "used", "begun", "bound", "room")


LOOPS_SQL = f"""SELECT g.proc, g.var, g.lo AS loop, u.node AS used, g.begun, g.bound, u.val % {ROOM} + 1 AS room FROM ({LOOPS}) g JOIN ({PART_STMT}) u ON u.proc = g.proc AND u.var = g.var AND u.op = 'index' AND u.node BETWEEN g.lo AND g.hi
  WHERE g.bound > u.val % {ROOM} + 1 AND EXISTS (SELECT 1 FROM ({PART_STMT}) p WHERE p.proc = g.proc AND p.var = g.var AND p.op = 'up' AND p.node BETWEEN g.lo AND g.hi)"""

#: The same procedures as lines of C, and null dereferences found in them.
C_LINES = f"""SELECT proc, node AS line, CASE op WHEN 'loop' THEN 'while (v' || CAST(var AS STRING) || ' != NULL) {{' WHEN 'begin' THEN 'if (v' || CAST(var AS STRING) || ') return;' WHEN 'up' THEN 'if(v' || CAST(var AS STRING) || ' == NULL) v = 0;' WHEN 'index' THEN 'use(v' || CAST(var AS STRING) || '[0]);' ELSE 'int n = ' || CAST(val AS STRING) || ';' END AS text FROM ({PART_STMT}) s"""
DEREFS = f"SELECT proc, node AS place, 'v' || CAST(var AS STRING) AS name, CASE WHEN val % 10 = 0 THEN 200 ELSE 70 + val % 31 END AS conf FROM ({PART_STMT}) s WHERE op = 'index'"
#: Whether the text checks the variable, by a test of it or by comparing it with NULL.
TESTED = "(text LIKE '%if (' || name || '%' OR text LIKE '%if(' || name || '%')"
COMPARED = "(text LIKE '%' || name || ' != NULL%' OR text LIKE '%' || name || ' == NULL%')"


def null_check_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: confidence of null dereferences, times 0.6 for a test of the variable among the lines from four before to two after, and
    again for a comparison with NULL; kept from 0.7 on. Confidence in hundredths."""
    found = _sql(spark, sf_dir, f"SELECT *, place - 4 AS lo, place + 2 AS hi FROM ({DEREFS}) d")
    lines = _sql(spark, sf_dir, f"SELECT proc, line, line AS line_end, text FROM ({C_LINES}) c")
    near = intervals.overlap_join(found, lines, ["proc"], ("lo", "hi"), ("line", "line_end"))
    judged = near.groupBy("proc", "place", "name", "conf").agg(F.bool_or(F.expr(TESTED)).alias("tested"), F.bool_or(F.expr(COMPARED)).alias("compared"))
    factor = lambda c: F.when(F.col(c), 6).otherwise(10)
    conf = F.col("conf") * factor("tested") * factor("compared")
    return judged.select("proc", "place", "name", "tested", "compared", conf.cast("bigint").alias("confidence"), (conf >= 7000).alias("kept"))


DISCOUNT_SQL = f"""SELECT proc, place, name, tested, compared, CAST(conf * CASE WHEN tested THEN 6 ELSE 10 END * CASE WHEN compared THEN 6 ELSE 10 END AS BIGINT) AS confidence, conf * CASE WHEN tested THEN 6 ELSE 10 END * CASE WHEN compared THEN 6 ELSE 10 END >= 7000 AS kept FROM (
  SELECT d.proc, d.place, d.name, d.conf, bool_or({TESTED}) AS tested, bool_or({COMPARED}) AS compared FROM ({DEREFS}) d JOIN ({C_LINES}) c ON c.proc = d.proc AND c.line BETWEEN d.place - 4 AND d.place + 2 GROUP BY d.proc, d.place, d.name, d.conf) j"""


#: Assignments between access paths of three variables: an order is a class, its items' numbers tell constructor (0), methods (1) and destructor (2).
SELECTORS = "CASE {0} % 7 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'a.b' WHEN 4 THEN 'a.0' WHEN 5 THEN 'b.a' ELSE 'c' END"
STRATUM = "CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 5 THEN 1 ELSE 2 END"
ASSIGNED = f"SELECT DISTINCT l_orderkey AS scope, {STRATUM} AS stratum, CAST(l_partkey % 3 AS INT) AS var, {SELECTORS.format('l_suppkey')} AS path, CAST((l_suppkey + l_linenumber) % 3 AS INT) AS from_var, {SELECTORS.format('(l_partkey + l_linenumber)')} AS from_path FROM lineitem"
TAINTS = f"SELECT l_orderkey AS scope, CAST(l_suppkey % 3 AS INT) AS var, {SELECTORS.format('(l_suppkey + l_partkey)')} AS path, min({STRATUM}) AS stratum FROM lineitem WHERE (l_partkey + l_linenumber) % 4 = 0 GROUP BY l_orderkey, l_suppkey % 3, {SELECTORS.format('(l_suppkey + l_partkey)')}"
MOVED = access_paths.moved("path", "from_path", "to_path")


def _tainted_paths(spark: SparkSession, sf_dir: str, strata: bool) -> DataFrame:
    # equal assignments move the same: they need no shuffle to be told apart
    taints, assigned = _sql(spark, sf_dir, TAINTS), _sql(spark, sf_dir, ASSIGNED.replace("SELECT DISTINCT", "SELECT", 1))
    if not strata:
        taints, assigned = taints.withColumn("stratum", F.lit(0)), assigned.withColumn("stratum", F.lit(0))
    return access_paths.access_paths(taints, assigned, views.dialect(MOVED, 0))


def field_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the tainted access paths of each scope, whatever the order of its assignments."""
    return _tainted_paths(spark, sf_dir, False).select("scope", "var", "path")


def member_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the same with constructor, methods and destructor one after the other: from which of them on is a path tainted."""
    return _tainted_paths(spark, sf_dir, True)


def _paths_sql(strata: bool) -> str:
    at = "stratum" if strata else "0 AS stratum"
    return f"""WITH RECURSIVE moves AS (SELECT DISTINCT scope, {at}, var, path AS to_path, from_var, from_path FROM ({ASSIGNED}) a), walk AS (SELECT scope, var, path, {at} FROM ({TAINTS}) t
    UNION SELECT w.scope, m.var, {access_paths.moved("w.path", "m.from_path", "m.to_path")}, m.stratum FROM walk w JOIN moves m ON m.scope = w.scope AND m.from_var = w.var AND w.stratum <= m.stratum WHERE {access_paths.below("w.path", "m.from_path")} OR {access_paths.below("m.from_path", "w.path")})"""


#: Lists, a part each: what is pushed at the end, taken from the front, and read by its index.
QUEUE = """SELECT l_partkey AS list, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS INT) AS at_row, CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'pop' WHEN 1 THEN 'read' ELSE 'push' END AS op, l_suppkey % 3 = 0 AS tainted, CAST(l_suppkey % 4 AS INT) AS index FROM lineitem"""


def queue_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """for each read of a list the element that its index names after all pops so far, and whether it is tainted."""
    return access_paths.queue_elements(_sql(spark, sf_dir, QUEUE).withColumnRenamed("at_row", "at")).withColumnRenamed("at", "at_row")


QUEUE_SQL = f"""WITH RECURSIVE ops AS ({QUEUE}), run AS (SELECT list, 0 AS at_row, CAST([] AS INT[]) AS held, CAST(NULL AS INT) AS index, CAST(NULL AS INT) AS element, false AS is_read FROM (SELECT DISTINCT list FROM ops) d
    UNION ALL SELECT o.list, o.at_row, CASE o.op WHEN 'push' THEN list_append(r.held, o.at_row) WHEN 'pop' THEN r.held[2:] ELSE r.held END, o.index, CASE WHEN o.op = 'read' THEN r.held[o.index + 1] END, o.op = 'read' FROM run r JOIN ops o ON o.list = r.list AND o.at_row = r.at_row + 1)
  SELECT r.list, r.at_row, r.index, r.element, coalesce(e.tainted, false) AS tainted FROM run r LEFT JOIN ops e ON e.list = r.list AND e.at_row = r.element WHERE r.is_read"""


#: Findings by tool, weakness and month.
DAILY = "SELECT l_suppkey % 3 AS tool, l_suppkey % 8 AS cwe, CAST(l_shipdate AS DATE) AS day, l_orderkey AS place, CAST(l_quantity AS BIGINT) AS amount, CAST(l_partkey % 40 AS STRING) AS rule FROM lineitem"
#: What estimates may be off by: relative for distinct counts, in rank for quantiles.
HLL_ERROR, KLL_ERROR = 0.08, 0.03


def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by (tool, weakness, day), rolled up to tools without the findings, and held to exact figures: are all within their bounds."""
    rows = _sql(spark, sf_dir, DAILY)
    daily = sketches.sketched(rows, ["tool", "cwe", "day"], F.col("place"), F.col("amount"), F.col("rule"))
    tools = sketches.estimated(sketches.rolled_up(sketches.rolled_up(daily, ["tool", "cwe"]), ["tool"]), ["tool"])
    exact = rows.groupBy("tool").agg(F.count_distinct("place").alias("d"))
    most = rows.groupBy("tool", "rule").count().groupBy("tool").agg(F.max("count").alias("most"))
    rank = rows.join(tools.select("tool", "p50", "p95"), "tool").groupBy("tool").agg(*[f(F.when(F.expr(f"amount {o} {p}"), 1).otherwise(0)).alias(f"{p}_{n}") for p in ("p50", "p95") for n, o, f in (("below", "<", F.avg), ("upto", "<=", F.avg))])
    all_in = tools.join(exact, "tool").join(most, "tool").join(rank.withColumnRenamed("tool", "t"), F.col("tool") == F.col("t"))
    held = lambda p, q: ((F.col(f"{p}_below") <= q + KLL_ERROR) & (F.col(f"{p}_upto") >= q - KLL_ERROR)).alias(f"{p}_holds")
    return all_in.select("tool", "n", (F.abs(F.col("distinct_places") - F.col("d")) <= F.greatest(F.lit(2), HLL_ERROR * F.col("d"))).alias("distinct_holds"), held("p50", 0.5), held("p95", 0.95), (F.col("top")[0]["count"] == F.col("most")).alias("top_holds"))


SKETCH_SQL = f"SELECT tool, count(*) AS n, true AS distinct_holds, true AS p50_holds, true AS p95_holds, true AS top_holds FROM ({DAILY}) d GROUP BY tool"


QUERIES: dict[str, Callable] = {
    "F8_reaching_definitions": reaching_definitions,
    "F9_ownership_at_exits": ownership_at_exits,
    "G10_null_dereferences": null_dereferences,
    "F6_dominators": dominators,
    "G2_unavoidable_recursion": uncontrolled_recursion,
    "F6_flow_order": flow_order,
    "F3_field_taint": field_taint,
    "F5_member_strata": member_strata,
    "F3_queue_elements": queue_reads,
    "D17_sketch_rollup": sketch_rollup,
    "C5_nearest_matches": nearest_matches,
    "C5_ordered_matches": ordered_matches,
    "H7_disjoint_folds": disjoint_folds,
    "C7_case_hits": case_hits,
    "G4_loop_bound": loop_overflows,
    "B2_checked_on_lines": null_check_discount,
    "L12_constants": constant_values,
    "B15_dead_branches": dead_branches,
    "G9_zero_divisors": zero_divisors,
    "F4_matched_calls": matched_calls,
    "D10_procedure_summaries": procedure_summaries,
    "C11_freeing_calls": freeing_calls,
    "F11_strong_parts": strong_parts,
    "F11_cycles": heap_cycles,
    "F11_simple_paths": heap_simple_paths,
    "F11_overlaps": heap_overlaps,
    "F11_doubly_linked": lambda spark, sf_dir: _sql(spark, sf_dir, DOUBLY_LINKED),
}

ORACLES: dict[str, str] = {
    "F8_reaching_definitions": REACHING_SQL,
    "F9_ownership_at_exits": OWNERSHIP_SQL,
    "G10_null_dereferences": NULL_SQL,
    "F6_dominators": DOMINATORS_SQL,
    "G2_unavoidable_recursion": RECURSION_SQL,
    "F6_flow_order": ORDER_SQL,
    "F3_field_taint": _paths_sql(False) + " SELECT DISTINCT scope, var, path FROM walk",
    "F5_member_strata": _paths_sql(True) + " SELECT scope, var, path, min(stratum) AS stratum FROM walk GROUP BY scope, var, path",
    "F3_queue_elements": QUEUE_SQL,
    "D17_sketch_rollup": SKETCH_SQL,
    "C5_nearest_matches": _greedy_sql("kind, gap,"),
    "C5_ordered_matches": _greedy_sql(""),
    "H7_disjoint_folds": FOLDS_SQL,
    "C7_case_hits": CASES_SQL,
    "G4_loop_bound": LOOPS_SQL,
    "B2_checked_on_lines": DISCOUNT_SQL,
    "L12_constants": VALUES_SQL,
    "B15_dead_branches": DEAD_SQL,
    "G9_zero_divisors": ZERO_SQL,
    "F4_matched_calls": MATCHED_SQL,
    "D10_procedure_summaries": SUMMARIES_SQL,
    "C11_freeing_calls": FREEING_SQL,
    "F11_strong_parts": STRONG_SQL,
    "F11_cycles": CYCLES_SQL,
    "F11_simple_paths": PATHS_SQL,
    "F11_overlaps": OVERLAPS_SQL,
    "F11_doubly_linked": DOUBLY_LINKED,
}
