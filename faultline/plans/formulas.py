"""Queries over formulas that are made from a part's numbers, so that the right answer follows from the same numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import kernels
from . import views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _chain(cell: str, n: str) -> str:
    """Cells i = 0 .. n - 1 joined by *; I is the number of a cell, J that of the next."""
    return f"array_join(transform(sequence(0, CAST({n} AS INT) - 1), i -> replace(replace('{cell}', 'I', CAST(i AS STRING)), 'J', CAST(i + 1 AS STRING))), ' * ')"


def _register(name: str, text: str, kernel, column: str, oracle: str) -> None:
    """A query: a formula for each part, through a kernel; and the answer by arithmetic."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = views.run(spark, sf_dir, f"SELECT p_partkey, {text} AS formula FROM part")
        return rows.select("p_partkey", kernel("formula").alias(column))

    QUERIES[name] = query
    ORACLES[name] = f"SELECT p_partkey, {oracle} AS {column} FROM part"


K, M = "(1 + p_size % 5)", "(1 + p_partkey % 7)"

_register(
    "M2_segments",
    f"""concat({_chain('xI |-> xJ', K)}, ' |- ls(x0, x', {M}, ')')""",
    kernels.check,
    "verdict",
    f"CASE WHEN {M} <= {K} THEN 'valid' ELSE 'invalid' END",
)
_register(
    "M3_satisfiability",
    f"""concat({_chain('xI |-> xJ', K)}, CASE p_partkey % 4 WHEN 0 THEN ' * x0 |-> y' WHEN 1 THEN ' & x0 = nil' WHEN 2 THEN concat(' & x0 = x', {K} - 1) ELSE ' & y != x0' END)""",
    kernels.check,
    "verdict",
    f"CASE p_partkey % 4 WHEN 0 THEN 'unsat' WHEN 1 THEN 'unsat' WHEN 2 THEN CASE WHEN {K} = 1 THEN 'sat' ELSE 'unsat' END ELSE 'sat' END",
)
_register(
    "M4_leftover",
    f"""concat({_chain('xI |-> (xJ, p)', K)}, ' * tree(t) |- ', array_join(transform(sequence(0, CAST({K} AS INT) - 1), i -> if(i = p_partkey % {K}, 'emp', concat('x', i, ' |-> (x', i + 1, ', p)'))), ' * '))""",
    kernels.leftover_of,
    "leftover",
    f"'tree(t) * x' || CAST(p_partkey % {K} AS STRING) || ' |-> (x' || CAST(p_partkey % {K} + 1 AS STRING) || ', p)'",
)
_register(
    "M4_abduction",
    f"""concat(CASE WHEN {K} > 1 THEN {_chain('xI |-> xJ', f'greatest(1, {K} - 1)')} ELSE 'emp' END, ' |- ', {_chain('xI |-> xJ', K)})""",
    kernels.abduced,
    "missing",
    f"'x' || CAST({K} - 1 AS STRING) || ' |-> x' || CAST({K} AS STRING)",
)
_register(
    "M5_bug_reachability",
    f"""concat({_chain('xI |-> xJ', K)}, ';', CASE p_partkey % 3 WHEN 0 THEN concat('x', {M}, 'q |-> y') WHEN 1 THEN concat('x', p_partkey % {K}, ' |-> y') ELSE concat('emp & x', {K}, ' = nil') END)""",
    kernels.bug,
    "verdict",
    "CASE p_partkey % 3 WHEN 1 THEN 'not_reachable' ELSE 'reachable' END",
)
_register(
    "M6_equality_classes",
    f"""concat(array_join(transform(sequence(0, CAST({K} AS INT) - 1), i -> concat('a', i, ' = a', i + 1)), ' & '), ' & p |-> a0 |- p |-> a', {M})""",
    kernels.check,
    "verdict",
    f"CASE WHEN {M} <= {K} THEN 'valid' ELSE 'invalid' END",
)
_register(
    "M7_wands",
    f"""concat('x |-> y * (', CASE WHEN p_partkey % 2 = 0 THEN 'x |-> y' ELSE concat('x |-> y', {M}) END, ' -* ', {_chain('zI |-> zJ', K)}, ') |- z0 |-> z1')""",
    kernels.check,
    "verdict",
    "CASE WHEN p_partkey % 2 = 0 THEN 'valid' ELSE 'unknown' END",
)
_register(
    "M8_existentials",
    f"""concat({_chain('xI |-> (xJ, dI)', K)}, ' |- exists a b. x', p_partkey % {K}, ' |-> (a, b)', CASE p_size % 2 WHEN 0 THEN concat(' & a = x', p_partkey % {K} + 1) ELSE ' & a = b' END)""",
    kernels.check,
    "verdict",
    "CASE p_size % 2 WHEN 0 THEN 'valid' ELSE 'invalid' END",
)
_register(
    "M9_footprints",
    f"""concat({_chain('xI |-> xJ', K)}, CASE p_partkey % 3 WHEN 0 THEN concat(' * x', {K}, ' |-> x0') WHEN 1 THEN ' * tree(t)' ELSE ' * ls(u, nil)' END)""",
    kernels.shape,
    "shape",
    f"""CASE p_partkey % 3 WHEN 0 THEN CAST({K} + 1 AS STRING) || '|0|' || list_aggregate(list_transform(range({K} + 1), lambda i: 'x' || CAST(i AS STRING)), 'string_agg', ',') || '|true|' || list_aggregate(list_transform(range({K} + 1), lambda i: 'x' || CAST(i AS STRING)), 'string_agg', ',')
      ELSE CAST({K} AS STRING) || '|1|' || CASE p_partkey % 3 WHEN 1 THEN 't,' ELSE 'u,' END || list_aggregate(list_transform(range({K} + 1), lambda i: 'x' || CAST(i AS STRING)), 'string_agg', ',') || '|false|' || list_aggregate(list_transform(range({K}), lambda i: 'x' || CAST(i AS STRING)), 'string_agg', ',') END""",
)
_register(
    "M10_blind_folding",
    f"""concat({_chain('xI |-> xJ', K)}, CASE p_partkey % 2 WHEN 0 THEN ' * t |-> (nil, u) * u |-> (nil, nil)' ELSE ' * s |-> (a, b)' END)""",
    kernels.folded,
    "folded",
    f"CASE p_partkey % 2 WHEN 0 THEN '' ELSE 'dll(s, s, b, a) * ' END || 'ls(x0, x' || CAST({K} AS STRING) || ')' || CASE p_partkey % 2 WHEN 0 THEN ' * tree(t)' ELSE '' END",
)
_register(
    "H4_ranked_proposals",
    f"""concat('a |-> b * b |-> c * ', {_chain('xI |-> xJ', K)})""",
    kernels.ranked_folds,
    "ranking",
    f"""list_aggregate(list_transform(list_sort(list_concat([[CAST(-1 AS BIGINT), 0, 0], [CAST(-2 AS BIGINT), 0, 1], [CAST(-1 AS BIGINT), 1, 2]], list_transform(flatten(list_transform(range({K}), lambda i: list_transform(range(i + 1, {K} + 1), lambda j: [i, j]))), lambda p: [CAST(p[1] - p[2] AS BIGINT), 2 + p[1], p[2]]))),
      lambda r: CASE WHEN r[2] = 0 THEN CASE WHEN r[3] = 0 THEN 'ls(a, b)' ELSE 'ls(a, c)' END WHEN r[2] = 1 THEN 'ls(b, c)' ELSE 'ls(x' || CAST(r[2] - 2 AS STRING) || ', x' || CAST(r[3] AS STRING) || ')' END), 'string_agg', '; ')
      || ' / ' || CASE WHEN {K} > 2 THEN 'ls(x0, x' || CAST({K} AS STRING) || '); ls(a, c)' ELSE 'ls(a, c); ls(x0, x' || CAST({K} AS STRING) || ')' END""",
)
_register(
    "M11_lemmas",
    f"""concat(array_join(transform(sequence(0, CAST({K} AS INT) - 1), i -> concat('ls(x', i, ', x', i + 1, ')')), ' * '), ' * ls(x', {K}, ', nil) |- ', CASE p_partkey % 3 WHEN 0 THEN 'list(x0)' WHEN 1 THEN 'ls(x0, nil)' ELSE 'tree(x0)' END)""",
    kernels.check,
    "verdict",
    "CASE p_partkey % 3 WHEN 2 THEN 'invalid' ELSE 'valid' END",
)
_register(
    "M11_lemmas_that_match",
    """CASE p_partkey % 4 WHEN 0 THEN 'ls(a, b) * ls(b, nil)' WHEN 1 THEN 'p |-> q * list(q)' WHEN 2 THEN 'p |-> (l, r) * tree(r) * tree(l)' ELSE 'ls(a, b) * ls(c, d)' END""",
    kernels.lemma_names,
    "lemmas",
    "CASE p_partkey % 4 WHEN 0 THEN 'append_to_end,segment_is_list' WHEN 1 THEN 'cons_list,list_is_segment' WHEN 2 THEN 'node_of_trees' ELSE '' END",
)

#: Predicates: one cell of each, a name for its whole, and a formula that does not follow.
_PREDICATES = (
    ("ls(x, nil) & x != nil", "exists z. x |-> z * ls(z, nil)", "ls(nil, x)"),
    ("tree(x) & x != nil", "exists l r. x |-> (l, r) * tree(l) * tree(r)", "list(x)"),
    ("f |-> (u, nil) * u |-> (nil, f)", "dll(f, u, nil, nil)", "dll(f, f, nil, nil)"),
    ("RList(x, y) * RList(y, z)", "RList(x, z)", "RList(z, x)"),
    ("nll(x, y, w) * nll(y, z, w)", "nll(x, z, w)", "nll(x, w, z)"),
    ("skl1(x, y) * skl1(y, z)", "skl1(x, z)", "skl1(z, y)"),
    ("x |-> (a, b) * b |-> (c, d)", "skl2(x, d)", "skl2(a, d)"),
    ("x |-> (a, b, c) * skl3(c, y)", "skl3(x, y)", "skl3(a, y)"),
    ("x |-> (4, y) * y |-> (6, z)", "sls(x, 1, z, 9)", "sls(x, 5, z, 9)"),
    ("x |-> (u, u) * lsso(u, y)", "lsso(x, y)", "lsso(y, x)"),
)
_N = len(_PREDICATES)
_register(
    "M12_predicates",
    f"""CASE p_partkey % {_N} {' '.join(f"WHEN {i} THEN concat('{a} |- ', if(p_size % 2 = 0, '{b}', '{c}'))" for i, (a, b, c) in enumerate(_PREDICATES))} END""",
    kernels.check,
    "verdict",
    "CASE p_size % 2 WHEN 0 THEN 'valid' ELSE 'invalid' END",
)
_register(
    "M13_definitions",
    """CASE p_partkey % 4 WHEN 0 THEN 'p(x, y) := x = y & emp | (exists z. x |-> z * p(z, y))' WHEN 1 THEN 'p(x, y) := x = y & emp | (exists z. z |-> x * p(z, y))'
      WHEN 2 THEN 'p(x) := exists z. x |-> z * p(z)' ELSE 'p(x) := x = nil & emp | (x |-> w * p(w))' END""",
    kernels.definition,
    "answer",
    "CASE p_partkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'p: a recursive case must allocate x' WHEN 2 THEN 'p: no case without recursion' ELSE 'p: unknown names [''w'']' END",
)
_register(
    "M14_descent",
    """CASE p_partkey % 3 WHEN 0 THEN 'sls(x, 3, y, 9) |- sls(x, 1, y, 9)' WHEN 1 THEN 'lsso(x, nil) |- lsso(x, nil)' ELSE 'ls(x, y) * y |-> z |- exists w. ls(x, w) * w |-> z' END""",
    kernels.check,
    "verdict",
    "'valid'",
)
_register(
    "M15_patterns",
    f"""concat('ls(X, Y) * Y |-> Z <- ', CASE p_partkey % 3 WHEN 0 THEN concat('b |-> c', {M}, ' * ls(a, b)') WHEN 1 THEN 'ls(a, b) * c |-> d' ELSE 'ls(q, nil) * nil |-> w' END)""",
    kernels.match,
    "names",
    f"CASE p_partkey % 3 WHEN 0 THEN 'X=a, Y=b, Z=c' || CAST({M} AS STRING) WHEN 2 THEN 'X=q, Y=nil, Z=w' END",
)
_register(
    "C15_lemma_patterns",
    f"""concat('RList(X, Y) * RList(Y, Z) <- RList(n', p_size % 3, ', n1) * RList(n', p_partkey % 3, ', n2)')""",
    kernels.match,
    "names",
    "CASE WHEN p_partkey % 3 = 1 AND p_size % 3 = 2 THEN 'X=n1, Y=n2, Z=n1' WHEN p_partkey % 3 = 1 THEN 'X=n' || CAST(p_size % 3 AS STRING) || ', Y=n1, Z=n2' WHEN p_size % 3 = 2 THEN 'X=n' || CAST(p_partkey % 3 AS STRING) || ', Y=n2, Z=n1' END",
)
_register(
    "M16_arithmetic",
    f"""concat('n < ', p_size, ' & n > ', p_partkey % 50, CASE WHEN p_partkey % 2 = 0 THEN ' & n + n = m' ELSE '' END)""",
    kernels.numbers,
    "verdict",
    "CASE WHEN p_size - p_partkey % 50 >= 2 THEN 'sat' ELSE 'unsat' END",
)
_register(
    "L11_linear_constraints",
    "concat('a + b <= ', p_size, ' & a >= ', p_partkey % 40, ' & b > ', p_partkey % 11)",
    kernels.numbers,
    "verdict",
    "CASE WHEN p_partkey % 40 + p_partkey % 11 + 1 <= p_size THEN 'sat' ELSE 'unsat' END",
)
_register(
    "H5_canonical_order",
    f"""concat('z |-> y', {M}, ' * a |-> b * (ls(q, nil) * ls(c, nil)) & y = b')""",
    kernels.canonical,
    "formula",
    f"'(a |-> b * ls(c, nil) * ls(q, nil) * z |-> y' || CAST({M} AS STRING) || ') & b = y'",
)
_register(
    "D15_formula_counts",
    f"""concat('exists q. ', {_chain('xI |-> q', K)}, ' * tree(q) * ls(a, nil)')""",
    kernels.shape,
    "shape",
    f"CAST({K} AS STRING) || '|2|a,' || list_aggregate(list_transform(range({K}), lambda i: 'x' || CAST(i AS STRING)), 'string_agg', ',') || '|false|' || list_aggregate(list_transform(range({K}), lambda i: 'x' || CAST(i AS STRING)), 'string_agg', ',')",
)
_register(
    "L7_first_json",
    """concat(repeat('x } ', CAST(p_size % 3 AS INT)), '{"a": {"b": "}', p_partkey, '"}, "c": [1, {}]} tail {"z": 1}')""",
    kernels.first_json,
    "body",
    """'{"a": {"b": "}' || CAST(p_partkey AS STRING) || '"}, "c": [1, {}]}'""",
)
_register(
    "L14_smt_text",
    """concat('"a', CASE p_size % 4 WHEN 0 THEN '""' WHEN 1 THEN concat(chr(92), 'u{62}') WHEN 2 THEN concat(chr(92), 'u0063') ELSE concat(chr(92), 'x64') END, p_partkey, '"')""",
    kernels.smt_text,
    "text",
    """'a' || CASE p_size % 4 WHEN 0 THEN '"' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END || CAST(p_partkey AS STRING)""",
)

_register(
    "M1_parse",
    f"""concat('a', {M}, ' |-> (b, nil) * ls(c, d) & e != ', p_size, CASE p_partkey % 3 WHEN 0 THEN ' | emp' WHEN 1 THEN ' | ' ELSE ' | exists q. q |-> a' END)""",
    kernels.tree,
    "tree",
    f"""CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE '(or (and (star (cell a' || CAST({M} AS STRING) || ' b nil) (pred ls c d)) (!= e ' || CAST(p_size AS STRING) || ')) ' || CASE p_partkey % 3 WHEN 0 THEN 'emp)' ELSE '(exists (''q'',) (cell q a)))' END END""",
)
_register(
    "F12_unfolding",
    """concat(CASE p_partkey % 4 WHEN 0 THEN 'ls(x, nil)' WHEN 1 THEN 'tree(x)' WHEN 2 THEN 'ls(x, nil) & x != nil' ELSE 'tree(x) * list(y)' END, ';', p_size % 8)""",
    kernels.unfolded,
    "heaps",
    """CAST(CASE p_partkey % 4 WHEN 0 THEN least(6, p_size % 8) + 1 WHEN 1 THEN list_extract([1, 2, 4, 9, 23, 65, 197], least(6, p_size % 8) + 1) WHEN 2 THEN least(6, p_size % 8)
      ELSE list_sum(list_transform(range(least(6, p_size % 8) + 1), lambda i: list_extract([1, 1, 2, 5, 14, 42, 132], i + 1) * (least(6, p_size % 8) + 1 - i))) END AS STRING)""",
)
_register(
    "M17_model_search",
    f"""concat({_chain('xI |-> xJ', K)}, ' |- ls(x0, x', {M}, ')')""",
    kernels.model,
    "found",
    f"CASE WHEN {M} <= {K} THEN 'none' ELSE 'model' END",
)

_LSEG = "(define-fun-rec lseg ((i R) (o R)) Bool (or (and (= i o) (_ emp R R)) (exists ((u R)) (and (distinct i o) (sep (pto i u) (lseg u o))))))"
_register(
    "M18_slcomp_cases",
    f"""concat('(set-logic QF_SHLS)(set-info :status ', if(p_partkey % 2 = 0, 'unsat', 'sat'), ')(declare-sort R 0){_LSEG}(assert (sep ',
      array_join(transform(sequence(0, CAST({K} AS INT) - 1), i -> concat('(pto x', i, ' ', if(i = {K} - 1, '(as nil R)', concat('x', i + 1)), ')')), ' '), ' (_ emp R R)))(assert (not (lseg x0 ', if(p_partkey % 2 = 0, '(as nil R)', concat('x', {M})), ')))(check-sat)')""",
    kernels.smt_case,
    "answer",
    "CASE WHEN p_partkey % 2 = 0 THEN 'unsat|unsat|' ELSE 'sat|sat|' END",
)
_register(
    "A14_smt_files",
    f"""concat('; file ', p_partkey, chr(10), '(set-info :status ', if(p_partkey % 3 = 0, 'unsat', 'sat'), ')', chr(10), CASE p_partkey % 3 WHEN 0 THEN '(assert (sep (pto x y) (pto x z)))' WHEN 1 THEN '(assert (sep (pto x y) (pto y z)))' ELSE '(assert (and (distinct x y) (= y z)))' END)""",
    kernels.smt_case,
    "answer",
    "CASE WHEN p_partkey % 3 = 0 THEN 'unsat|unsat|' ELSE 'sat|sat|' END",
)
_register(
    "L9_bitvector_cases",
    """concat('(assert (= x (bvadd (_ bv', p_size * 7, ' 8) #x05)))(assert (', CASE p_partkey % 4 WHEN 0 THEN 'bvult x #x80' WHEN 1 THEN 'bvslt x #x00' WHEN 2 THEN '= (bvurem x #x07) #x00' ELSE '= (bvashr x #x07) #xff' END, '))')""",
    kernels.smt_ground,
    "answer",
    """'unknown|' || CASE WHEN CASE p_partkey % 4 WHEN 0 THEN (p_size * 7 + 5) % 256 < 128 WHEN 1 THEN (p_size * 7 + 5) % 256 >= 128 WHEN 2 THEN (p_size * 7 + 5) % 256 % 7 = 0 ELSE (p_size * 7 + 5) % 256 >= 128 END THEN 'sat' ELSE 'unsat' END""",
)
_register(
    "L10_array_cases",
    """concat('(assert (= a (store (store ((as const (Array Int Int)) 4) ', p_size % 5, ' 7) ', p_partkey % 5, ' 9)))(assert (= (select a ', p_size % 5, ') ', CASE p_partkey % 3 WHEN 0 THEN '7' WHEN 1 THEN '9' ELSE '4' END, '))')""",
    kernels.smt_ground,
    "answer",
    "'unknown|' || CASE WHEN CASE WHEN p_size % 5 = p_partkey % 5 THEN 9 ELSE 7 END = CASE p_partkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 9 ELSE 4 END THEN 'sat' ELSE 'unsat' END",
)
_register(
    "L8_string_cases",
    """concat('(assert (= s (str.++ "ab" "', p_partkey, '")))(assert (', CASE p_size % 3 WHEN 0 THEN concat('= (str.len s) ', 2 + length(CAST(p_partkey AS STRING))) WHEN 1 THEN 'str.prefixof "b" s' ELSE 'str.contains s "1"' END, '))')""",
    kernels.smt_ground,
    "answer",
    "'unknown|' || CASE p_size % 3 WHEN 0 THEN 'sat' WHEN 1 THEN 'unsat' ELSE CASE WHEN contains(CAST(p_partkey AS STRING), '1') THEN 'sat' ELSE 'unsat' END END",
)

def entailment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch file's lines: blank lines and # and // comments are skipped, the rest is checked; written as CSV and read back."""
    from pyspark.sql import functions as F

    from ..operators.fixpoint import new_folder

    text = f"""CASE p_partkey % 5 WHEN 0 THEN concat('# note ', p_partkey) WHEN 1 THEN '  // x |-> y |- emp' ELSE concat('  ', {_chain('xI |-> xJ', K)}, ' |- x', {M}, ' |-> x', {M} + 1, '  ') END"""
    folder = new_folder(spark, "lines")
    views.run(spark, sf_dir, f"SELECT concat(p_partkey, char(9), {text}) AS value FROM part").write.text(folder)
    lines = spark.read.text(folder).select(F.split("value", "\t")[0].cast("long").alias("p_partkey"), F.trim(F.split("value", "\t")[1]).alias("formula"))
    kept = lines.filter("formula <> '' AND NOT formula LIKE '#%' AND NOT formula LIKE '//%'")
    out = new_folder(spark, "csv")
    kept.select("p_partkey", "formula", kernels.check("formula").alias("verdict")).write.option("header", True).csv(out)
    return spark.read.option("header", True).schema("p_partkey long, formula string, verdict string").csv(out).select("p_partkey", "verdict")


QUERIES["A15_entailment_lines"] = entailment_lines
ORACLES["A15_entailment_lines"] = f"SELECT p_partkey, CASE WHEN {M} < {K} THEN 'valid' ELSE 'invalid' END AS verdict FROM part WHERE p_partkey % 5 > 1"
QUERIES["A20_batch_csv"] = lambda spark, sf_dir: entailment_lines(spark, sf_dir).groupBy("verdict").count().withColumnRenamed("count", "n")
ORACLES["A20_batch_csv"] = f"SELECT verdict, count(*) AS n FROM ({ORACLES['A15_entailment_lines']}) t GROUP BY verdict"
