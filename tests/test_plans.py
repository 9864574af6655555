"""The whole catalog against DuckDB on the smallest tables, and laws of the operators."""

import duckdb
import pytest

import __spark_entry__
from faultline.functions import dims
from faultline.operators import findings, fixpoint
from faultline.plans import catalog, registry, views

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in views.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(str([None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]}) t").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert all(isinstance(q, str) or len(q) == 2 for q in catalog.SQL.values())


def test_fixpoint_on_cycles_and_row_order(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (6, 7)]
    seeds = spark.createDataFrame([(1,)], "node long")
    want = {(1, 0), (2, 1), (3, 2), (4, 3)}
    for rows in (edges, edges[::-1], edges * 2):
        assert {tuple(r) for r in fixpoint.reachable(seeds, spark.createDataFrame(rows, "src long, dst long")).collect()} == want
    assert {tuple(r) for r in fixpoint.components(spark.createDataFrame(edges, "src long, dst long")).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 6)}


def test_must_hold_needs_every_path(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "src long, dst long")
    nodes = spark.range(5).select("id").withColumnRenamed("id", "node")
    entry = spark.createDataFrame([(0, "a"), (0, "b")], "node long, fact string")
    kills = spark.createDataFrame([(1, "a")], "node long, fact string")
    got = {tuple(r) for r in fixpoint.must_hold(nodes, edges, entry, kills).collect()}
    assert got == {(0, "a"), (0, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "b")}


def test_anchored_clusters(spark):
    rows = spark.createDataFrame([("f", x) for x in (1, 3, 4, 5, 8, 9)], "file string, line int")
    got = sorted((r.line, r.anchor) for r in findings.anchored_clusters(rows, ["file"], "line", 3).collect())
    assert got == [(1, 1), (3, 1), (4, 1), (5, 5), (8, 5), (9, 9)]


def test_anchored_clusters_of_many_lines(spark):
    import random

    r = random.Random(2)
    rows = [(k, x) for k in ("a", "b", None) for x in sorted(r.sample(range(3000), 700 if k == "a" else 9))]
    want = set()
    for k in ("a", "b", None):
        anchor = None
        for _, x in filter(lambda row: row[0] == k, rows):
            anchor = x if anchor is None or x - anchor > 5 else anchor
            want.add((k, x, anchor))
    df = spark.createDataFrame(rows * 2, "file string, line int")
    assert set(map(tuple, findings.anchored_clusters(df, ["file"], "line", 5).collect())) == want


def test_greedy_matches_are_one_to_one(spark):
    pairs = spark.createDataFrame([("f", 1, 2), ("f", 1, 1), ("f", 3, 2), ("f", 3, 1)], "file string, left_line int, right_line int")
    assert {(r.left_line, r.right_line) for r in findings.greedy_matches(pairs, ["file"]).collect()} == {(1, 1), (3, 2)}


def test_call_graph_queries_read_all_calls(spark, duck):
    """All of v_call, by brute force."""
    edges = {(int(a[1:]), int(b[1:])) for a, b in duck.sql(views.with_views("SELECT caller, callee FROM v_call", 1)).fetchall()}

    def closure(seeds, pairs):
        depth, todo = dict.fromkeys(seeds, 0), list(seeds)
        after = {}
        for a, b in pairs:
            after.setdefault(a, []).append(b)
        for node in todo:
            for b in after.get(node, []):
                if b not in depth:
                    depth[b] = depth[node] + 1
                    todo.append(b)
        return depth

    rows = lambda name: {tuple(r) for r in registry.queries()[name](spark, SF).collect()}
    reached = closure([5], edges)
    assert rows("F4_interprocedural") == set(reached.items())
    assert rows("F4_callers") == {(n,) for n in closure(range(10), {(b, a) for a, b in edges})}
    fails = {(n, k) for k in range(5) for n in closure([60 * k], edges)}
    assert rows("D14_must_hold") == {(n, k) for n in reached if n < 300 for k in range(5)} - fails
    both, left, members = edges | {(b, a) for a, b in edges}, {n for e in edges for n in e}, set()
    while left:
        group = set(closure([min(left)], both))
        members.add((min(group), len(group)))
        left -= group
    assert rows("F10_equality_classes") == members


def test_cookie_flags_read_all_events(spark, duck):
    kinds = {}
    for user, kind in duck.sql("SELECT user_id, event_type FROM events").fetchall():
        kinds.setdefault(user, set()).add(kind)
    want = {(u, "view" in k, "error" in k, "CWE-614" if "error" not in k else "CWE-1004" if "view" not in k else "none") for u, k in kinds.items()}
    got = registry.queries()["G16_cookie_flags"](spark, SF).select("user_id", "http_only", "secure", "cwe").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_heap_paths_start_at_every_origin(spark, duck):
    after = {}
    for a, b in duck.sql(views.with_views("SELECT src, dst FROM v_heap", 1)).fetchall():
        after.setdefault(a, set()).add(b)
    want = set()
    for origin in after:
        depth, now = {}, {origin}
        for step in range(1, 11):
            now = {b for a in now for b in after.get(a, ()) if step == 1 or b != origin} - set(depth)
            depth |= dict.fromkeys(now, step)
        want |= {(origin, n, d) for n, d in depth.items()}
    got = registry.queries()["F11_heap_paths"](spark, SF).select("origin", "node", "depth").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_bfs_has_no_depth_bound(spark, tmp_path):
    """A cycle of 41 nodes: 7 * key + size is the next key, modulo the number of parts."""
    n = 41
    spark.createDataFrame([(k, (k + 1 - 7 * k) % n) for k in range(n)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["F6_bfs_depth"](spark, str(tmp_path)).select("node", "depth").collect()
    assert {tuple(r) for r in got} == {(k, k) for k in range(n)}


def test_source_scan_and_sarif_take_all_rows(spark, tmp_path):
    spark.createDataFrame([(k, 1) for k in range(290, 320)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["A8_python_scan"](spark, str(tmp_path)).select("file", "line", "type", "source_line").collect()
    assert sorted(tuple(r) for r in got) == [(f"f{k}.py", 5, "command_injection", 3) for k in range(290, 320) if k % 3]
    whole = views.run(spark, SF, "SELECT DISTINCT location, line, type, cwe, severity FROM v_finding WHERE cwe IS NOT NULL").count()
    assert sum(r.n for r in registry.queries()["A18_sarif_round_trip"](spark, SF).collect()) == whole


def beside(tmp_path, spark, name, rows):
    """The smallest tables with another one in place of name, and DuckDB on them."""
    for t in views.TABLES:
        if t != name:
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    c = duckdb.connect()
    for t in views.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{'/*.parquet' if t == name else ''}'")
    return c


def same_as_sql(spark, duck, tmp_path, query):
    df = registry.queries()[query](spark, str(tmp_path))
    got = df.collect()
    assert plain(got) == plain(duck.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[query]}) t").fetchall())
    return got


def test_a_letter_keeps_its_place_in_another_case(spark, tmp_path):
    """A sharp s, ligatures, a letter with an iota below, a dotted capital I and a sigma at the end of a word."""
    texts = ["ßach", "ŉabc", "ﬁabc", "ᾳabc", "ᾼabc", "ᾁabc", "ΐabc", "İabc", "xİab", "xΑΣ y", "xΑΣ", "a\U0001f600Bc", "éÀÉ", "", None]
    duck = beside(tmp_path, spark, "documents", spark.createDataFrame([(i, t, "de", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r.doc_id: r.head for r in same_as_sql(spark, duck, tmp_path, "L8_strings")}
    assert got[0] == "ẞach" and got[9] == "Xασ "


def test_sessions_end_by_whole_seconds(spark, tmp_path):
    """Gaps of 1,799.6, 1,800 and 1,800.4 seconds, some of which are 1,800 whole ones, and 1,799."""
    times = [0.9, 1800.5, 3600.5, 5400.9, 7199.9, 8999.3, 500000.0]
    rows = [(i, 7, 1700000000.0 + t) for i, t in enumerate(times)] + [(50 + i, 8, 1700000000.0 + 90000 * i) for i in range(7)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, at double").selectExpr("event_id", "CAST(timestamp_micros(CAST(round(at * 1000000) AS BIGINT)) AS TIMESTAMP_NTZ) AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "'' AS props")
    duck = beside(tmp_path, spark, "events", events)
    assert sum(r.user_id == 7 for r in same_as_sql(spark, duck, tmp_path, "N3_stream_sessions")) == 6


def test_ancestors_of_weaknesses_without_findings(spark):
    """All pairs of the hierarchy, by a plain walk; most weaknesses have no finding."""
    above = {}
    for child, parent in dims.CWE_PARENTS:
        above.setdefault(child, set()).add(parent)
    want, todo = set(), [(c, p) for c in above for p in above[c]]
    while todo:
        pair = todo.pop()
        if pair not in want:
            want.add(pair)
            todo += [(pair[0], p) for p in above.get(pair[1], ())]
    rows = registry.queries()["F7_cwe_ancestors"](spark, SF).collect()
    assert {(r.child, r.ancestor) for r in rows} == {(f"CWE-{c}", f"CWE-{p}") for c, p in want}
    assert any(r.findings > 0 for r in rows) and any(r.findings == 0 for r in rows)
