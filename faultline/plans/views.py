"""Derived views over the given tables, as CTE text for Spark and DuckDB, and the query builder that puts in what a query names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import dims
from ..operators.fixpoint import new_folder, release
from . import cases

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name: (Spark SQL, DuckDB SQL); one text where both are the same.
VIEWS: dict[str, str | tuple[str, str]] = {
    "v_finding_all": """SELECT 'src/pkg' || CAST(l_orderkey % 17 AS STRING) || '/mod_' || CAST(l_orderkey % 200 AS STRING) || CASE l_orderkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.c' ELSE '.js' END AS location,
      'proc_' || CAST(l_partkey % 40 AS STRING) AS proc, CAST(l_linenumber * 3 + CAST(l_quantity AS INT) % 7 AS INT) AS line,
      CASE l_suppkey % 8 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'xss' WHEN 2 THEN 'command_injection' WHEN 3 THEN 'path_traversal' WHEN 4 THEN 'buffer_overflow' WHEN 5 THEN 'use_after_free' WHEN 6 THEN 'null_dereference' ELSE 'custom_rule' END AS type,
      CASE l_suppkey % 8 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-79' WHEN 2 THEN 'CWE-78' WHEN 3 THEN 'CWE-22' WHEN 4 THEN 'CWE-120' WHEN 5 THEN 'CWE-416' WHEN 6 THEN 'CWE-476' END AS cwe,
      CASE WHEN l_returnflag = 'R' THEN 'critical' WHEN l_returnflag = 'A' THEN 'high' WHEN l_linestatus = 'O' THEN 'medium' ELSE 'low' END AS severity,
      CAST(100 - round(l_discount * 500) AS INT) AS conf, CAST(l_partkey % 5 AS INT) AS flow_len, l_tax > 0.04 AS witness, 'repo' || CAST(l_orderkey % 5 AS STRING) AS repo,
      CASE WHEN l_suppkey % 3 = 0 THEN 'alpha' WHEN l_suppkey % 3 = 1 THEN 'beta' ELSE 'gamma' END AS tool FROM lineitem""",
    "v_finding": "SELECT DISTINCT location, proc, line, type, cwe, severity, conf, flow_len, witness, repo, tool FROM v_finding_all",
    "v_ranked": "SELECT f.*, r.rank FROM v_finding f JOIN severity_rank r ON f.severity = r.severity",
    "v_truth": "SELECT DISTINCT repo, location, cwe, CAST(line + conf % 9 - 4 AS INT) AS line, CASE WHEN conf % 4 = 0 THEN 'false_positive' ELSE 'true_positive' END AS status FROM v_finding WHERE cwe IS NOT NULL AND (line + conf) % 3 = 0",
    "v_call": "SELECT DISTINCT 'c' || CAST(o_custkey % 300 AS STRING) AS caller, 'p' || CAST(l_partkey % 300 AS STRING) AS callee FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "v_instr": (
        "SELECT user_id AS proc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, CAST(get_json_object(props, '$.k') AS INT) % 8 AS var, CASE event_type WHEN 'signup' THEN 'alloc' WHEN 'purchase' THEN 'free' WHEN 'view' THEN 'use' WHEN 'click' THEN 'assign' ELSE 'sink' END AS op, CAST(value AS INT) AS val, event_id FROM events",
        "SELECT user_id AS proc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, CAST(json_extract_string(props, '$.k') AS INT) % 8 AS var, CASE event_type WHEN 'signup' THEN 'alloc' WHEN 'purchase' THEN 'free' WHEN 'view' THEN 'use' WHEN 'click' THEN 'assign' ELSE 'sink' END AS op, CAST(trunc(value) AS INT) AS val, event_id FROM events",
    ),
    "v_line": (
        "SELECT doc_id, source, CAST(pos + 1 AS INT) AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, '\n')) t AS pos, line",
        "SELECT doc_id, source, CAST(unnest(range(1, len(p) + 1)) AS INT) AS line_no, unnest(p) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents)",
    ),
    "v_heap": "SELECT p_partkey AS src, (p_partkey * 7 + p_size) % (SELECT count(*) FROM part) AS dst FROM part",
    # Programs: an order is a procedure (or a heap), its line items are statements (or cells). Node 0 is the entry, size + 1 the exit.
    "v_stmt": """SELECT l_orderkey AS proc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS node, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS size,
      CASE (l_partkey + 3 * l_suppkey + l_linenumber) % 12 WHEN 0 THEN 'source' WHEN 1 THEN 'source' WHEN 2 THEN 'const' WHEN 3 THEN 'copy' WHEN 4 THEN 'copy' WHEN 5 THEN 'add' WHEN 6 THEN 'free' WHEN 7 THEN 'call' WHEN 8 THEN 'sink' WHEN 9 THEN 'branch' WHEN 10 THEN 'loop' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'return' ELSE 'call' END END AS op,
      CAST(l_partkey % 4 AS INT) AS tgt, CAST((l_suppkey + l_linenumber) % 4 AS INT) AS src, CAST(l_quantity AS INT) AS val, CAST((l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM orders) AS BIGINT) AS callee, l_partkey AS pk, l_suppkey AS sk FROM lineitem""",
    "v_step": """SELECT proc, 0 AS src, 1 AS dst, 'next' AS label FROM v_stmt WHERE node = 1
      UNION ALL SELECT proc, node, CASE WHEN op = 'return' THEN size + 1 ELSE node + 1 END, CASE op WHEN 'branch' THEN 'true' WHEN 'loop' THEN 'false' ELSE 'next' END FROM v_stmt
      UNION ALL SELECT proc, node, least(node + 2 + val % 3, size + 1), 'false' FROM v_stmt WHERE op = 'branch'
      UNION ALL SELECT proc, node, greatest(1, node - val % 3), 'true' FROM v_stmt WHERE op = 'loop'""",
    "v_cell": "SELECT proc * 1000000 + node AS cell, proc * 1000000 + pk % size + 1 AS next, proc * 1000000 + sk % size + 1 AS prev FROM v_stmt",
    "v_path": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'src/main/java/A' WHEN 1 THEN 'node_modules/x/b' WHEN 2 THEN 'tests/unit/test_c' WHEN 3 THEN 'lib/vendor/d' WHEN 4 THEN 'app/e.generated' ELSE 'cmd/f' END || CAST(doc_id AS STRING) || CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.ts' WHEN 3 THEN '.cpp' WHEN 4 THEN '.cs' WHEN 5 THEN '.go' WHEN 6 THEN '.md' ELSE '' END AS path, text FROM documents",
    "v_program": cases.program_view(),
    "v_label": cases.label_view(),
    "vuln": dims.VULN,
    "cwe_edge": dims.CWE_EDGE,
    "sink_alias": dims.SINK_ALIAS,
    "severity_rank": dims.SEVERITY,
}

#: Letters whose upper case in Java is several letters, where there is one letter for it too. Java spells the others of that kind out,
#: and one in lower case (a dotted capital I); it also takes a sigma at the end of a word for another letter. Here a letter becomes one letter.
WIDE_LOWER = "ß" + "".join(chr(c) for row in (0x1F80, 0x1F90, 0x1FA0) for c in range(row, row + 16)) + "\u1fb3\u1fbc\u1fc3\u1fcc\u1ff3\u1ffc"
WIDE_UPPER = "ẞ" + "".join(chr(c) for row in (0x1F88, 0x1F98, 0x1FA8) for c in [*range(row, row + 8)] * 2) + "\u1fbc\u1fbc\u1fcc\u1fcc\u1ffc\u1ffc"

#: Functions that have other names, or need other text, in the two dialects.
MACROS = {
    "RX": ("regexp_like({0}, {1})", "regexp_matches({0}, {1})"),
    "RXALL": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "SETOF": ("concat_ws(',', array_sort(collect_set({0})))", "coalesce(array_to_string(list_sort(list(DISTINCT {0}) FILTER (WHERE {0} IS NOT NULL)), ','), '')"),
    "count_if": ("count(CASE WHEN {0} THEN 1 END)", "count(CASE WHEN {0} THEN 1 END)"),
    "ISUM": ("CAST(sum({0}) AS BIGINT)", "CAST(sum({0}) AS BIGINT)"),
    "FDIV": ("CAST(floor(({0}) / CAST({1} AS DOUBLE)) AS BIGINT)", "CAST(floor(({0}) / CAST({1} AS DOUBLE)) AS BIGINT)"),
    "RATIO": ("round(CAST({0} AS DOUBLE) / CAST({1} AS DOUBLE), 4)", "round(CAST({0} AS DOUBLE) / CAST({1} AS DOUBLE), 4)"),
    "DAYTEXT": ("CAST(CAST({0} AS DATE) AS STRING)", "CAST(CAST({0} AS DATE) AS STRING)"),
    "SECONDS": ("CAST(unix_timestamp(CAST({0} AS TIMESTAMP)) AS BIGINT)", "CAST(floor(epoch({0})) AS BIGINT)"),
    "LASTOF": ("last({0}, true)", "last_value({0} IGNORE NULLS)"),
    "AROUNDROWS": ("concat_ws(' / ', collect_list({0}) OVER ({1} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))", "array_to_string(list({0}) OVER ({1} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), ' / ')"),
    "RXONE": ("regexp_extract({0}, {1}, 1)", "regexp_extract({0}, {1}, 1)"),
    "ENDSIN": ("endswith({0}, {1})", "suffix({0}, {1})"),
    "BASENAME": ("substring_index({0}, '/', -1)", "list_last(string_split({0}, '/'))"),
    "UPCASE": (f"array_join(transform(split({{0}}, ''), c -> CASE WHEN length(upper(c)) > 1 THEN translate(c, '{WIDE_LOWER}', '{WIDE_UPPER}') ELSE upper(c) END), '')", "upper({0})"),
    "DOWNCASE": ("array_join(transform(split({0}, ''), c -> CASE WHEN length(lower(c)) > 1 THEN 'i' ELSE lower(c) END), '')", "lower({0})"),
    "BITAND": ("({0} & {1})", "({0} & {1})"),
    "SHL": ("shiftleft({0}, {1})", "({0} << {1})"),
    "SHR": ("shiftright({0}, {1})", "({0} >> {1})"),
    "XOR": ("({0} ^ {1})", "xor({0}, {1})"),
    "SIGNED": ("(({0} + 128) % 256 - 128)", "(({0} + 128) % 256 - 128)"),
    "CHOP": ("(CASE WHEN {0} < 0 THEN ceil({0}) ELSE floor({0}) END)", "trunc({0})"),
}


def _split_arguments(text: str) -> tuple[list[str], int]:
    """Arguments of a call whose opening bracket was just read, and where it ends."""
    parts, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        if quoted:
            continue
        if c == "," and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return [*parts, text[start:i].strip()], i
    raise ValueError("unclosed call")


def dialect(sql: str, which: int) -> str:
    """Macros written out for Spark (0) or DuckDB (1)."""
    while m := re.search(rf"\b({'|'.join(MACROS)})\(", sql):
        parts, end = _split_arguments(sql[m.end() :])
        sql = sql[: m.start()] + MACROS[m[1]][which].format(*parts) + sql[m.end() + end + 1 :]
    return sql


def _needed(sql: str, known: list[str]) -> list[str]:
    return [n for n in known if re.search(rf"\b{n}\b", sql)]


def with_views(sql: str, which: int, sf_dir: str | None = None) -> str:
    """The query with the views (and for Spark the tables) that it names as CTEs in front."""
    texts = {k: v if isinstance(v, str) else v[which] for k, v in VIEWS.items()}
    wanted: list[str] = []

    def visit(text: str) -> None:
        for n in _needed(text, list(texts)):
            if n not in wanted:
                visit("" if texts[n].startswith(f"{n} AS") else texts[n])
                wanted.append(n)

    visit(sql)
    parts = [texts[n] if texts[n].startswith(f"{n} AS") else f"{n} AS ({texts[n]})" for n in wanted]
    if which == 0:
        used = _needed(" ".join([sql, *parts]), TABLES)
        parts = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used] + parts
    head = "WITH RECURSIVE " if re.match(r"\s*WITH RECURSIVE\b", sql) else "WITH "
    body = re.sub(r"^\s*WITH( RECURSIVE)?\s", "", sql)
    if not parts:
        return dialect(sql, which)
    joined = ", ".join(parts) + (", " if re.match(r"\s*WITH\b", sql) else " ")
    return dialect(head + joined + body, which)


#: Views that several queries read and that cost a shuffle: written once for each session and input.
WRITTEN = ("v_finding", "v_stmt")
_KEPT: dict[tuple, str] = {}


def _state(spark: SparkSession, sf_dir: str, tables: list[str]) -> tuple:
    """When the tables' files were written, and their sizes."""
    out = []
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        out += [(t, len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0))]
    return tuple(out)


def kept(spark: SparkSession, sf_dir: str, name: str, make, tables: list[str]) -> str:
    """Where the table that make() gives lies: written to the shared folder by the first query that asks for it, and again if one of the tables that it is made of has changed."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    state = _state(spark, sf_dir, tables)
    if _KEPT.get(at, (None,))[0] != state:
        path = new_folder(spark, name)
        make().write.parquet(path)
        release(spark)
        if at in _KEPT:
            old = spark._jvm.org.apache.hadoop.fs.Path(_KEPT[at][1])
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        _KEPT[at] = (state, path)
    return _KEPT[at][1]


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = with_views(sql, 0, sf_dir)
    for name in WRITTEN:
        if re.search(rf"\b{name} AS \(", text):
            body = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
            whole = with_views(body, 0, sf_dir)
            path = kept(spark, sf_dir, name, lambda whole=whole: spark.sql(whole), sorted(set(re.findall(r"/(\w+)\.parquet`", whole))))
            text = text.replace(f"{name} AS ({dialect(body, 0)})", f"{name} AS (SELECT * FROM parquet.`{path}`)")
    return spark.sql(text)
