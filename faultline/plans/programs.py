"""Queries that start from program text: labelled programs, and programs made from a part's numbers whose findings follow from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import line_rules, relational_taint
from ..scan import engine, specs
from . import views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read; the programs are made of parts."""
    return spark.read.parquet(views.kept(spark, sf_dir, name, make, ["part"]))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all labelled programs, written once for each session and input."""
    return _kept(spark, sf_dir, "scanned", lambda: engine.scan(views.run(spark, sf_dir, "SELECT filename, text FROM v_program")))


def _labelled(name: str, types: list[str] | None, condition: str = "true") -> None:
    """A query for the findings of some types, and the labels of those types."""
    wanted = "true" if types is None else f"type IN ({', '.join(repr(t) for t in types)})"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _scanned(spark, sf_dir).filter("error IS NULL").select(F.col("file").alias("filename"), "line", "type", "source_line")
        return found.filter(f"({wanted}) AND ({condition})")

    QUERIES[name] = query
    ORACLES[name] = f"SELECT filename, line, type, source_line FROM v_label WHERE ({wanted}) AND ({condition})"


SCRIPT, JAVA, SHARP, PY = ("filename LIKE '%.{}'".format(x) for x in ("js", "java", "cs", "py"))
NATIVE = "(filename LIKE '%.c' OR filename LIKE '%.cpp')"

for _name, _types, _where in (
    ("A3_scan_programs", None, "true"),
    ("A8_python_programs", None, PY),
    ("A8_javascript_programs", None, SCRIPT),
    ("A8_java_programs", None, JAVA),
    ("A8_csharp_programs", None, SHARP),
    ("A8_native_programs", None, NATIVE),
    ("B10_xss_programs", ["xss"], "true"),
    ("B12_idor_programs", ["idor"], "true"),
    ("B14_unbounded_allocation", ["unbounded_allocation"], "true"),
    ("B17_scanf_and_formats", ["format_string", "buffer_overflow"], NATIVE),
    ("C4_usage_sinks", ["weak_hash", "weak_crypto", "insecure_random", "csrf", "dangerous_function"], "true"),
    ("F1_path_findings", ["command_injection", "sql_injection", "code_injection"], "true"),
    ("F8_uninitialised_programs", ["uninitialized_var"], "true"),
    ("F13_heap_programs", ["use_after_free", "double_free", "null_dereference", "memory_leak", "invalid_free", "mismatched_free", "return_stack_address"], NATIVE),
    ("F14_class_lifecycle", ["double_free", "use_after_free"], "filename LIKE '%.cpp'"),
    ("G1_infinite_loop", ["infinite_loop"], "true"),
    ("G2_uncontrolled_recursion", ["uncontrolled_recursion"], "true"),
    ("G3_index_out_of_bounds", ["oob_write", "oob_read", "oob_underwrite", "oob_underread"], "true"),
    ("G6_unchecked_return_programs", ["unchecked_return"], "true"),
    ("G7_large_stack_objects", ["excessive_allocation"], "true"),
    ("G8_world_writable_programs", ["incorrect_permissions"], "true"),
    ("G9_divide_by_zero", ["divide_by_zero"], "true"),
    ("G10_null_dereference", ["null_dereference"], "true"),
    ("G11_heap_misuse_programs", ["use_after_free", "double_free", "invalid_free", "mismatched_free", "return_stack_address"], "true"),
    ("G12_memory_leak", ["memory_leak"], "true"),
    ("G13_hardcoded_secrets", ["hardcoded_secret"], "true"),
    ("G14_regex_dos", ["regex_dos"], "true"),
    ("G15_prototype_pollution", ["prototype_pollution"], "true"),
    ("G16_cookies_and_deserializers", ["insecure_cookie", "insecure_cookie_httponly", "deserialization", "csrf"], "true"),
    ("G17_weak_algorithms", ["weak_hash", "weak_crypto"], "true"),
    ("G18_markup_sinks", ["xss"], SCRIPT),
    ("G19_request_bindings", ["sql_injection"], f"({JAVA} OR {SHARP})"),
    ("G21_buffer_copies", ["buffer_overflow"], "true"),
):
    _labelled(_name, _types, _where)


# programs whose findings follow from a part's numbers

#: A chain of assignments from a source to a sink, cut by a sanitizer in every third part, with a branch that may set it clean.
CHAIN = """SELECT p_partkey, p_size % 7 AS k, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 5 ELSE -1 END AS cut, p_partkey % 4 AS shape, 'src/c' || CAST(p_partkey AS STRING) || '.py' AS filename FROM part"""


def _chain_text() -> str:
    step = "transform(sequence(1, 7), i -> if(i <= k, concat('    a', i, ' = ', if(i - 1 = cut, concat('shlex.quote(a', i - 1, ')'), concat('a', i - 1, ' + \"', i, '\"')), '\\n'), ''))"
    branch = """CASE shape WHEN 0 THEN '' WHEN 1 THEN concat('    if flag:\\n        a', k, ' = "clean"\\n') WHEN 2 THEN concat('    a', k, ' = "clean"\\n') ELSE concat('    while flag:\\n        b = a', k, '\\n        flag = b\\n') END"""
    return f"SELECT filename, concat('import os, shlex\\ndef run(flag):\\n    a0 = input()\\n', array_join({step}, ''), {branch}, '    os.system(a', k, ')\\n') AS text FROM ({CHAIN}) c"


def chain_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-sensitive: an assignment on every path cleans, one on some paths does not."""
    found = engine.scan(views.run(spark, sf_dir, _chain_text()))
    return found.filter("error IS NULL").select(F.col("file").alias("filename"), "line", "type", "source_line")


QUERIES["F2_chain_findings"] = chain_findings
ORACLES["F2_chain_findings"] = f"""SELECT filename, CAST(4 + k + CASE shape WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INT) AS line, 'command_injection' AS type, CAST(3 AS INT) AS source_line
  FROM ({CHAIN}) c WHERE shape <> 2 AND NOT (cut >= 0 AND cut < k)"""


def chain_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same programs by joins over their instructions: candidate names against the spec rows, flow edges to a fixpoint, sinks.
    Flow-insensitive: an assignment never cleans."""
    rows = _kept(spark, sf_dir, "chain_facts", lambda: engine.facts(views.run(spark, sf_dir, _chain_text())))
    return relational_taint.findings(rows, specs.table(spark), "python").select(F.col("file").alias("filename"), "line", "type", "source_line")


QUERIES["F2_taint_by_joins"] = chain_by_joins
ORACLES["F2_taint_by_joins"] = f"""SELECT filename, CAST(4 + k + CASE shape WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INT) AS line, 'command_injection' AS type, CAST(3 AS INT) AS source_line
  FROM ({CHAIN}) c WHERE NOT (cut >= 0 AND cut < k)"""

#: Elements, keys and fields: which of them is tainted, and which is read.
ELEMENTS = "SELECT p_partkey, p_size % 4 AS put, p_partkey % 4 AS got, p_partkey % 3 AS shape, 'src/e' || CAST(p_partkey AS STRING) AS stem FROM part"


def element_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"""SELECT concat(stem, if(shape = 2, '.java', '.py')) AS filename, CASE shape
      WHEN 0 THEN concat('def run():\\n    d = {{}}\\n    d["k', put, '"] = input()\\n    d["k', (put + 1) % 4, '"] = "x"\\n    eval(d.get("k', got, '"))\\n')
      WHEN 1 THEN concat('class B:\\n    def __init__(self):\\n        self.f', put, ' = input()\\n    def use(self):\\n        eval(self.f', got, ')\\n')
      ELSE concat('class B {{ void f(HttpServletRequest request) {{\\nList<String> v = new ArrayList<>();\\nString p = request.getParameter("p");\\n', array_join(transform(sequence(0, 3), i -> concat('v.add(', if(i = put, 'p', '"x"'), '); ')), ''), '\\nstatement.execute(v.get(', got, '));\\n}} }}\\n') END AS text
      FROM ({ELEMENTS}) e""".replace("{{", "{").replace("}}", "}")
    found = engine.scan(views.run(spark, sf_dir, text))
    return found.filter("error IS NULL").select(F.col("file").alias("filename"), "line", "type", "source_line")


QUERIES["F3_element_taint"] = element_findings
ORACLES["F3_element_taint"] = f"""SELECT stem || CASE WHEN shape = 2 THEN '.java' ELSE '.py' END AS filename, CAST(5 AS INT) AS line, CASE WHEN shape = 2 THEN 'sql_injection' ELSE 'code_injection' END AS type, CAST(3 AS INT) AS source_line
  FROM ({ELEMENTS}) e WHERE put = got"""

#: A chain of calls: the last function holds the sink, one on the way may sanitize, the source is at the top or in a callee's result.
CALLCHAIN = "SELECT p_partkey, p_size % 8 AS k, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 10 ELSE -1 END AS cut, p_partkey % 2 AS returned, 'src/i' || CAST(p_partkey AS STRING) || '.py' AS filename FROM part"


def call_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"""SELECT filename, concat('import os, shlex\\ndef src():\\n    return input()\\n', array_join(transform(sequence(0, 7), i -> if(i < k, concat('def f', i, '(x):\\n    f', i + 1, '(', if(i = cut, 'shlex.quote(x)', 'x'), ')\\n'), '')), ''),
      'def f', k, '(x):\\n    os.system(x)\\n', 'f0(', if(returned = 1, 'src()', 'input()'), ')\\n') AS text FROM ({CALLCHAIN}) c"""
    found = engine.scan(views.run(spark, sf_dir, text))
    return found.filter("error IS NULL").select(F.col("file").alias("filename"), "line", "type", "source_line")


QUERIES["F4_calls_between_functions"] = call_findings
ORACLES["F4_calls_between_functions"] = f"""SELECT filename, CAST(5 + 2 * k AS INT) AS line, 'command_injection' AS type, CAST(CASE WHEN returned = 1 THEN 3 ELSE 6 + 2 * k END AS INT) AS source_line FROM ({CALLCHAIN}) c WHERE NOT (cut >= 0 AND cut < k)"""

#: Methods in any order around the constructor that fills a member; a destructor-like method comes last.
MEMBERS = "SELECT p_partkey, p_size % 3 AS place, CAST(p_partkey % 3 AS INT) AS field, 'src/m' || CAST(p_partkey AS STRING) || '.js' AS filename FROM part"


def member_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"""SELECT filename, concat('class K {{\\n', CASE place WHEN 0 THEN concat('constructor() {{ this.a = prompt(); this.b = 1; }}\\nuse() {{ eval(this.', element_at(array('a', 'b', 'c'), field + 1), '); }}\\nother() {{ }}\\n')
      WHEN 1 THEN concat('use() {{ eval(this.', element_at(array('a', 'b', 'c'), field + 1), '); }}\\nconstructor() {{ this.a = prompt(); this.b = 1; }}\\nother() {{ }}\\n')
      ELSE concat('other() {{ }}\\nuse() {{ eval(this.', element_at(array('a', 'b', 'c'), field + 1), '); }}\\nconstructor() {{ this.a = prompt(); this.b = 1; }}\\n') END, '}}\\n') AS text FROM ({MEMBERS}) m""".replace("{{", "{").replace("}}", "}")
    found = engine.scan(views.run(spark, sf_dir, text))
    return found.filter("error IS NULL").select(F.col("file").alias("filename"), "line", "type", "source_line")


QUERIES["F5_member_taint"] = member_findings
ORACLES["F5_member_taint"] = f"SELECT filename, CAST(CASE place WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 3 END AS INT) AS line, 'code_injection' AS type, CAST(CASE place WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS INT) AS source_line FROM ({MEMBERS}) m WHERE field = 0"

#: Dead branches by folded constants, guards and validation patterns before a sink.
GUARDS = "SELECT p_partkey, p_size % 10 AS shape, p_partkey % 7 AS n, 'src/g' || CAST(p_partkey AS STRING) || '.py' AS filename FROM part"
_GUARD_LINES = [
    "if x == \"fixed\":",
    "if x != \"fixed\":",
    "if x in (\"a\", \"b\"):",
    "if x.isdigit():",
    "if not x.isalnum():",
    "if \"..\" in x:",
    "if \"..\" not in x:",
    "if x.startswith(\"/srv/\"):",
    "if 7 * 18 + NN > 128:",
    "if 7 * 18 + NN <= 128:",
]


def guard_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ", ".join("'" + g.replace("'", "\\'") + "'" for g in _GUARD_LINES)
    text = f"""SELECT filename, concat('def run():\\n    x = input()\\n    ', replace(element_at(array({lines}), shape + 1), 'NN', CAST(n AS STRING)), '\\n        open(x)\\n    else:\\n        eval(x)\\n') AS text FROM ({GUARDS}) g"""
    found = engine.scan(views.run(spark, sf_dir, text))
    return found.filter("error IS NULL").select(F.col("file").alias("filename"), "line", "type", "source_line")


QUERIES["B16_guards_and_dead_branches"] = guard_findings
ORACLES["B16_guards_and_dead_branches"] = f"""SELECT filename, CAST(CASE part WHEN 0 THEN 4 ELSE 6 END AS INT) AS line, CASE part WHEN 0 THEN 'path_traversal' ELSE 'code_injection' END AS type, CAST(2 AS INT) AS source_line
  FROM ({GUARDS}) g CROSS JOIN (SELECT 0 AS part UNION ALL SELECT 1) p WHERE CASE
  WHEN shape IN (0, 2, 3) THEN part = 1 WHEN shape IN (1, 4) THEN part = 0 WHEN shape = 5 THEN true WHEN shape IN (6, 7) THEN part = 1
  WHEN shape = 8 THEN (126 + n > 128) = (part = 0) ELSE (126 + n <= 128) = (part = 0) END"""


# calls against the spec rows

#: Call names: a receiver in front of a name that the rows may or may not have.
_RECEIVERS = ("", "self.", "app.lib.", "x.y.z.")
_CALLEES = ("os.system", "execute", "cursor.execute", "pickle.loads", "shlex.quote", "no.such.call", "request.args", "eval", "hashlib.md5", "db.fetch_all")
CALLSITES = f"SELECT p_partkey, CASE p_size % 4 {' '.join(f'WHEN {i} THEN {r!r}' for i, r in enumerate(_RECEIVERS))} END || CASE p_partkey % 10 {' '.join(f'WHEN {i} THEN {c!r}' for i, c in enumerate(_CALLEES))} END AS callee FROM part"


def _spec_values() -> str:
    own = [s for s in specs.rows("python") if s.role in ("source", "sink", "usage", "sanitizer")]
    return "(VALUES " + ", ".join(f"('{s.name}', '{s.role}', '{s.kind}', 1)" for s in own) + ", ('z.execute', 'sink', 'own', 2), ('no.such.call', 'sink', 'own', 2), ('os.system', 'sink', 'replaced', 2))"


def _lookup(explode: str) -> str:
    return f"""SELECT p_partkey, callee, role, name AS spec_name, kind FROM (SELECT c.*, s.role, s.name, s.kind, row_number() OVER (PARTITION BY p_partkey, s.role ORDER BY c.cut, s.precedence DESC, s.kind) AS r
      FROM ({explode}) c JOIN (SELECT * FROM {_spec_values()} AS t(name, role, kind, precedence)) s ON c.candidate = s.name) x WHERE r = 1"""


def spec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a call site takes, by role: its whole name, else its longest dotted suffix; a user's row before the library's."""
    extra = specs.read_rows('{"language": "python", "name": "z.execute", "role": "sink", "kind": "own"}\n{"language": "python", "name": "no.such.call", "role": "sink", "kind": "own"}\n{"language": "python", "name": "os.system", "role": "sink", "kind": "replaced"}')
    sites = views.run(spark, sf_dir, CALLSITES)
    return relational_taint.looked_up(sites, specs.table(spark, tuple(extra)).filter("language = 'python' AND role IN ('source', 'sink', 'usage', 'sanitizer')"), ["p_partkey", "callee"]).select("p_partkey", "callee", "role", "spec_name", "kind")


QUERIES["C1_spec_lookup"] = spec_lookup
ORACLES["C1_spec_lookup"] = _lookup(f"SELECT p_partkey, callee, cut, array_to_string(list_slice(string_split(callee, '.'), cut + 1, len(string_split(callee, '.'))), '.') AS candidate FROM (SELECT p_partkey, callee, unnest(range(len(string_split(callee, '.')))) AS cut FROM ({CALLSITES}) q) w")
#: Methods of receivers of unknown type.
_METHODS = ("h.args", "a.b.get_json", "r7.META", "x.system", "conn9.execute", "s.upper", "os.system", "META", "q.cookies", "no.call")
TYPED_SITES = f"SELECT p_partkey, CASE p_partkey % 10 {' '.join(f'WHEN {i} THEN {c!r}' for i, c in enumerate(_METHODS))} END AS callee FROM part"


def typed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods whose own name is in no row, under the types that receivers may have."""
    rows = specs.table(spark).filter("language = 'python' AND role IN ('source', 'sink', 'usage', 'sanitizer')")
    return relational_taint.looked_up(views.run(spark, sf_dir, TYPED_SITES), rows, ["p_partkey", "callee"]).select("p_partkey", "callee", "role", "spec_name", "kind")


def _typed_sql() -> str:
    own = [s for s in specs.rows("python") if s.role in ("source", "sink", "usage", "sanitizer")]
    types = ", ".join(f"({i}, '{t}')" for i, t in enumerate(relational_taint.TYPE_PREFIXES))
    parts = "string_split(callee, '.')"
    return f"""SELECT p_partkey, callee, role, spec_name, kind FROM (SELECT c.p_partkey, c.callee, s.role, s.name AS spec_name, s.kind, row_number() OVER (PARTITION BY c.p_partkey, s.role ORDER BY c.cut, s.kind) AS r FROM (
        SELECT p_partkey, callee, cut, array_to_string(list_slice({parts}, cut + 1, len({parts})), '.') AS candidate FROM (SELECT p_partkey, callee, unnest(range(len({parts}))) AS cut FROM ({TYPED_SITES}) q) w
        UNION ALL SELECT p_partkey, callee, 100 + t.n, t.type || '.' || list_last({parts}) FROM ({TYPED_SITES}) q CROSS JOIN (VALUES {types}) AS t(n, type) WHERE len({parts}) > 1) c
      JOIN (VALUES {", ".join(f"('{s.name}', '{s.role}', '{s.kind}')" for s in own)}) AS s(name, role, kind) ON c.candidate = s.name) x WHERE r = 1"""


QUERIES["C1_type_prefixes"] = typed_lookup
ORACLES["C1_type_prefixes"] = _typed_sql()
QUERIES["C2_spec_effects"] = lambda spark, sf_dir: spec_lookup(spark, sf_dir).groupBy("role", "kind").agg(F.count("*").alias("calls"))
ORACLES["C2_spec_effects"] = f"SELECT role, kind, count(*) AS calls FROM ({ORACLES['C1_spec_lookup']}) z GROUP BY role, kind"
#: Users' rows as JSON lines, one in five parts with a sink or sanitizer of its own.
USER_ROWS = """SELECT '{"language": "python", "name": "lib' || CAST(p_partkey AS STRING) || '.run", "role": "' || CASE WHEN p_size % 2 = 0 THEN 'sink' ELSE 'sanitizer' END || '", "kind": "' || CASE WHEN p_size % 3 = 0 THEN 'shell' ELSE 'sql' END || '"}' AS line FROM part WHERE p_size % 5 = 0"""


def spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's rows and the users' rows, which are read where they lie, by language and role."""
    user = views.run(spark, sf_dir, USER_ROWS).select(F.from_json("line", "language string, name string, role string, kind string").alias("r")).select("r.*")
    return specs.table(spark).select("language", "name", "role", "kind").unionByName(user).groupBy("language", "role").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


QUERIES["P1_spec_rows"] = spec_rows


def _spec_counts() -> str:
    rows = [(lang, s.role, s.name) for lang in specs.TABLES for s in specs.rows(lang)]
    user = "SELECT 'python', CASE WHEN p_size % 2 = 0 THEN 'sink' ELSE 'sanitizer' END, 'lib' || CAST(p_partkey AS STRING) || '.run' FROM part WHERE p_size % 5 = 0"
    return "SELECT language, role, count(*) AS n, count(DISTINCT name) AS n_names FROM (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows) + f") AS t(language, role, name) UNION ALL {user}) u GROUP BY language, role"


ORACLES["P1_spec_rows"] = _spec_counts()


# facts

def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points of the call-chain programs: procedures that nothing in their file calls."""
    rows = engine.facts(views.run(spark, sf_dir, f"SELECT filename, concat('def a():\\n    b()\\n', if(k % 2 = 0, 'def b():\\n    c()\\n', 'def b():\\n    pass\\n    return 1\\n'), 'def c():\\n    return a\\n') AS text FROM ({CALLCHAIN}) q"))
    procs = rows.filter("proc <> '<module>'").select("file", "proc").distinct()
    called = rows.filter("op = 'call'").select("file", F.col("callee").alias("proc")).distinct()
    return procs.join(called, ["file", "proc"], "left_anti").select(F.col("file").alias("filename"), "proc")


QUERIES["C12_entry_procedures"] = call_graph
ORACLES["C12_entry_procedures"] = f"SELECT filename, proc FROM ({CALLCHAIN}) q CROSS JOIN (VALUES ('a'), ('c')) AS t(proc) WHERE proc = 'a' OR k % 2 = 1"


def graph_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest node and the number of edges of each program's flow graph: a chain of k steps and a branch."""
    edges = engine.flow_edges(views.run(spark, sf_dir, _chain_text())).filter("proc = 'run'")
    return edges.groupBy(F.col("file").alias("filename")).agg(F.count("*").alias("n_edges"), F.count_if("holds").alias("taken"))


QUERIES["F6_flow_graphs"] = graph_depths
ORACLES["F6_flow_graphs"] = f"SELECT filename, CAST(3 + k + CASE shape WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 4 END AS BIGINT) AS n_edges, CAST(CASE WHEN shape IN (1, 3) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM ({CHAIN}) c"

#: A function whose parameter of one place reaches a sink, called with the tainted value in another or the same place.
ARGUMENTS = "SELECT p_partkey, CAST(p_size % 3 AS INT) AS used, CAST(p_partkey % 3 AS INT) AS given, 'src/p' || CAST(p_partkey AS STRING) || '.py' AS filename FROM part"


def argument_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that hand a tainted variable to a parameter that the callee hands to a sink, by joins on callee and place."""
    text = f"""SELECT filename, concat('def f(a, b, c):\\n    eval(', element_at(array('a', 'b', 'c'), used + 1), ')\\ndef g():\\n    x = input()\\n    f(', array_join(transform(sequence(0, 2), i -> if(i = given, 'x', '0')), ', '), ')\\n') AS text FROM ({ARGUMENTS}) q"""
    rows = _kept(spark, sf_dir, "argument_facts", lambda: engine.facts(views.run(spark, sf_dir, text)))
    return relational_taint.argument_sinks(rows, specs.table(spark), "python").select(F.col("file").alias("filename"), "callee", "place", "line")


QUERIES["C10_argument_sinks"] = argument_sinks
ORACLES["C10_argument_sinks"] = f"SELECT filename, 'f' AS callee, given AS place, CAST(5 AS INT) AS line FROM ({ARGUMENTS}) q WHERE used = given"

#: Wrappers around free, each calling the next; what the outermost is called with is freed.
WRAPPERS = "SELECT p_partkey, CAST(p_size % 4 AS INT) AS k, CAST(p_partkey % 2 AS INT) AS place, 'src/w' || CAST(p_partkey AS STRING) || '.c' AS filename FROM part"


def callee_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that a function frees, through any number of functions of its file."""
    text = f"""SELECT filename, concat('void w0(char *p, char *q) {{ free(', if(place = 0, 'p', 'q'), '); }}\\n', array_join(transform(sequence(1, 3), i -> if(i <= k, concat('void w', i, '(char *p, char *q) {{ w', i - 1, '(p, q); }}\\n'), '')), ''), 'void other(char *p) {{ puts(p); }}\\n') AS text FROM ({WRAPPERS}) q""".replace("{{", "{").replace("}}", "}")
    return engine.summaries(views.run(spark, sf_dir, text)).select(F.col("file").alias("filename"), "proc", "frees")


QUERIES["C11_callee_summaries"] = callee_summaries
ORACLES["C11_callee_summaries"] = f"SELECT filename, 'w' || CAST(i AS STRING) AS proc, place AS frees FROM ({WRAPPERS}) q JOIN (VALUES (0), (1), (2), (3)) AS n(i) ON i <= k"
QUERIES["F15_function_summaries"] = lambda spark, sf_dir: callee_summaries(spark, sf_dir).groupBy("proc", "frees").agg(F.count("*").alias("n"))
ORACLES["F15_function_summaries"] = f"SELECT proc, frees, count(*) AS n FROM ({ORACLES['C11_callee_summaries']}) t GROUP BY proc, frees"

#: A C line for each part, by its number, and the weakness that the line rules give it.
C_LINES = (
    ("char *t = strtok(s, x);", 676),
    ("DES_set_key(k);", 327),
    ("SHA1_Init(&c);", 328),
    ("int r = rand();", 338),
    ("LoadLibraryA(\"evil.dll\");", 426),
    ("char *p = (char *)0x400000;", 587),
    ("assert(0);", 617),
    ("int m = INT_MAX + 1;", 190),
    ("signal(SIGINT, handler);", 364),
    ("x = strlen(s);", None),
    ("// assert(0);", None),
    ("char *d = malloc(strlen(s) + 1);", None),
    ("char *d = malloc(strlen(s));", 122),
    ("try { f(); } catch (...) { }", 390),
)
CLINES = f"SELECT 'src/l' || CAST(p_partkey AS STRING) || '.c' AS filename, CAST(p_size % 6 AS INT) AS pad, p_partkey % {len(C_LINES)} AS rule FROM part"


def c_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ", ".join("'" + text.replace("'", "\\'") + "'" for text, _ in C_LINES)
    text = f"SELECT filename, concat(repeat('int a;\\n', pad), element_at(array({lines}), CAST(rule + 1 AS INT)), '\\n') AS text FROM ({CLINES}) c"
    return line_rules.c_line_rules(views.run(spark, sf_dir, text)).select(F.col("file").alias("filename"), "line", "cwe")


QUERIES["G20_line_rules"] = c_lines
ORACLES["G20_line_rules"] = f"SELECT filename, CAST(pad + 1 AS INT) AS line, 'CWE-' || CAST(w.cwe AS STRING) AS cwe FROM ({CLINES}) c JOIN (SELECT * FROM (VALUES {', '.join(f'({i}, {cwe})' for i, (_, cwe) in enumerate(C_LINES) if cwe)}) AS t(rule, cwe)) w ON c.rule = w.rule"


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted files without a text give an error row, files with a byte-order mark are read as others."""
    text = "SELECT 'w' || CAST(p_partkey AS STRING) || '.py' AS filename, CASE p_size % 3 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN concat(decode(unhex('EFBBBF'), 'UTF-8'), 'eval(input())\\n') ELSE 'def broken(:\\n' END AS text FROM part"
    found = engine.scan(views.run(spark, sf_dir, text))
    return found.select(F.col("file").alias("filename"), "line", "type", F.col("error").isNotNull().alias("failed"))


QUERIES["A1_files_and_errors"] = missing_files
ORACLES["A1_files_and_errors"] = "SELECT 'w' || CAST(p_partkey AS STRING) || '.py' AS filename, CASE WHEN p_size % 3 = 1 THEN CAST(1 AS INT) END AS line, CASE WHEN p_size % 3 = 1 THEN 'code_injection' END AS type, p_size % 3 <> 1 AS failed FROM part"
