"""Operators on small programs and random graphs, against plain loops."""

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from faultline.operators import access_paths, constants, fixpoint, flow, graphs, intervals, matching, sketches, tabulation, whole, whole_calls, whole_graphs
from faultline.plans import analyses, views


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def programs(n, seed):
    """Random procedures of up to 8 nodes, node 0 first; some nodes cannot be reached."""
    r = random.Random(seed)
    out = []
    for proc in range(n):
        size = r.randint(1, 7)
        edges = {(a, r.randint(0, size), r.choice(["", "true", "false"])) for a in range(size + 1) for _ in range(r.choice([0, 1, 1, 2]))}
        out.append((proc, size + 1, sorted(edges)))
    return out


def reach(edges, start, without=None):
    seen, todo = {start} - {without}, [start] if start != without else []
    for a in todo:
        for x, y, *_ in edges:
            if x == a and y not in seen and y != without:
                seen.add(y)
                todo.append(y)
    return seen


def test_flow_facts_against_a_worklist(spark):
    """May and must, kills by part, and what edges end and bring, on graphs with loops and unreached nodes."""
    r = random.Random(5)
    gen, kill, egen, ekill, starts, edges = [], [], [], [], [], []
    for proc, size, own in programs(60, 1):
        edges += [(proc, *e) for e in own]
        gen += [(proc, r.randrange(size), f, f % 2) for f in range(4) for _ in range(r.choice([0, 1]))]
        kill += [(proc, r.randrange(size), r.randrange(2)) for _ in range(r.choice([0, 1, 2]))]
        egen += [(proc, *r.choice(own), f, f % 2) for f in range(3) if own and r.random() < 0.2]
        ekill += [(proc, *r.choice(own), r.randrange(2)) for _ in range(2) if own and r.random() < 0.4]
        starts += [(proc, 0, 9, 1)]
    want = set()
    for proc, size, own in programs(60, 1):
        facts = {(f, p) for q, _, f, p in gen + starts if q == proc} | {(f, p) for q, _, _, _, f, p in egen if q == proc}
        seen = reach(own, 0)

        def after(node, label_edge, held):
            out = {x for x in held if (proc, node, x[1]) not in kill} | {(f, p) for q, n, f, p in gen if (q, n) == (proc, node)}
            out = {x for x in out if (proc, *label_edge, x[1]) not in ekill}
            return out | {(f, p) for q, a, b, c, f, p in egen if (q, a, b, c) == (proc, *label_edge)}

        may = {n: {(9, 1)} if n == 0 else set() for n in seen}
        must = {n: {(9, 1)} if n == 0 else set(facts) for n in seen}
        for _ in range(200):
            for a, b, c in own:
                if a in seen:
                    may[b] |= after(a, (a, b, c), may[a])
                    must[b] &= after(a, (a, b, c), must[a])
        assert all(must[n] <= may[n] for n in seen)
        want |= {(proc, n, f, p, (f, p) in must[n]) for n in seen for f, p in may[n]}
    frame = lambda data, names: spark.createDataFrame(data, ", ".join(f"{x} {'string' if x == 'label' else 'int'}" for x in names.split()))
    given = dict(
        gen=frame(gen, "proc node fact part"), kill=frame(kill, "proc node part"), at_start=frame(starts, "proc node fact part"),
        edge_gen=frame(egen, "proc src dst label fact part"), edge_kill=frame(ekill, "proc src dst label part"),
    )
    first, links = frame([s[:2] for s in starts], "proc node"), frame(edges, "proc src dst label")
    assert set(map(tuple, flow.flow_facts(links, first, **given).collect())) == want
    assert {tuple(r)[:4] for r in flow.flow_facts(links, first, ask="must", **given).collect()} == {w[:4] for w in want if w[4]}


def test_a_procedure_of_many_facts(spark):
    """More facts than a word has bits, in one procedure."""
    n = 300
    edges = spark.range(n).selectExpr("0 AS proc", "CAST(id % 3 AS INT) AS src", "CAST(id % 3 + 1 AS INT) AS dst").distinct()
    gen = spark.range(n).selectExpr("0 AS proc", "0 AS node", "CAST(id AS INT) AS fact", "CAST(id % 2 AS INT) AS part")
    kill = spark.createDataFrame([(0, 2, 1)], "proc int, node int, part int")
    got = flow.flow_facts(edges, spark.createDataFrame([(0, 0)], "proc int, node int"), gen=gen, kill=kill)
    assert {(r.node, r["count"]) for r in got.groupBy("node").count().collect()} == {(1, n), (2, n), (3, n // 2)}


def test_dominators_against_removal(spark):
    edges = [(p, a, b, c) for p, _, own in programs(50, 2) for a, b, c in own]
    starts = [(p, 0) for p, _, _ in programs(50, 2)]
    want = {(p, n, d) for p, size, own in programs(50, 2) for n in reach(own, 0) for d in range(size) if d in reach(own, 0) and (n == d or n not in reach(own, 0, d))}
    got = flow.dominators(spark.createDataFrame(edges, "proc int, src int, dst int, label string"), spark.createDataFrame(starts, "proc int, node int"))
    assert set(map(tuple, got.collect())) == want


CALLS = "proc string, node int, fact int, callee string, entry int, entry_fact int"
RETURNS = "proc string, node int, callee string, exit int, exit_fact int, to_node int, to_fact int"


def program(spark, calls, order):
    """Procedures of one call each: node 0, call at 1 of its argument (fact 1), node 2 the exit; NOTHING is 0."""
    flows, entered, back = [], [], []
    for proc in order:
        callee, passes = calls.get(proc, (None, True))
        flows += [(proc, 0, f, 1, f) for f in (0, 1)] + [(proc, 1, 0, 2, 0)]
        if callee is None:
            flows += [(proc, 1, 1, 2, 1)] if passes else []
        else:
            entered += [(proc, 1, f, callee, 0, f) for f in (0, 1)]
            back += [(proc, 1, callee, 2, 1, 2, 1)]
    back += [("none", 0, p, 2, 1, 0, 1) for p in order[:1]]
    return spark.createDataFrame(flows, "proc string, node int, fact int, to_node int, to_fact int"), spark.createDataFrame(entered, CALLS), spark.createDataFrame(back, RETURNS)


def test_calls_return_to_their_caller_only(spark):
    """One callee, called with a tainted and with a clean argument: one result is tainted."""
    calls = {"dirty": ("id", True), "clean": ("id", True)}
    flows, entered, back = program(spark, calls, ["dirty", "clean", "id"])
    starts = spark.createDataFrame([("dirty", 0, 1), ("clean", 0, 0)], "proc string, node int, fact int")
    got = set(map(tuple, tabulation.tabulate(flows, entered, back, starts).filter("node = 2 AND fact = 1").select("proc", "given").collect()))
    assert got == {("dirty", 1), ("id", 1)}


@pytest.mark.parametrize("reverse", [False, True])
def test_chains_of_any_depth_in_any_order(spark, reverse):
    """Wrappers in a chain; then the same with the last one calling itself, where nothing comes back."""
    names = [f"p{i}" for i in range(6)]
    chain = {a: (b, True) for a, b in pairwise(names)}
    order = names[::-1] if reverse else names
    starts = spark.createDataFrame([("p0", 0, 1)], "proc string, node int, fact int")
    paths = tabulation.tabulate(*program(spark, chain, order), starts)
    ends = tabulation.summaries(paths, spark.createDataFrame([(p, 2) for p in names], "proc string, node int"))
    assert rows(ends) == sorted((p, 1, 1) for p in names)
    if reverse:
        endless = chain | {"p5": ("p5", True)}
        paths = tabulation.tabulate(*program(spark, endless, order), starts)
        assert paths.filter("node = 2 AND fact = 1").count() == 0 and paths.filter("proc = 'p5'").count() > 0


def random_edges(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize(("n", "m"), [(30, 45), (1, 3)])
def test_strong_components_and_levels(spark, n, m):
    edges = random_edges(n, m, n + m)
    far = {a: reach(edges, a) for a in {x for e in edges for x in e}}
    part = {a: max(b for b in far[a] if a in far[b]) for a in far}
    df = spark.createDataFrame(edges, "src int, dst int")
    got = {r.node: (r.component, r.level) for r in graphs.levels(df).collect()}
    assert {a: c for a, (c, _) in got.items()} == part

    def depth(c, known={}):  # noqa: B006
        before = {part[a] for a, b in edges if part[b] == c and part[a] != c}
        return 1 + max((depth(x) for x in before), default=-1)

    assert all(level == depth(part[a]) for a, (_, level) in got.items())
    assert all(got[a][1] < got[b][1] for a, b in edges if part[a] != part[b])


def test_simple_paths_and_cycles(spark):
    edges = random_edges(7, 14, 3) + [(2, 2)]

    def ways(path):
        yield path
        for a, b in set(edges):
            if a == path[-1] and b not in path:
                yield from ways([*path, b])

    df = spark.createDataFrame(edges, "src int, dst int")
    got = graphs.simple_paths(spark.createDataFrame([(0,), (3,)], "node int"), df)
    assert sorted(map(list, (r.path for r in got.collect()))) == sorted(w for s in (0, 3) for w in ways([s]))
    loops = {tuple(w) for s in range(7) for w in ways([s]) if (w[-1], s) in edges and min(w) == s}
    assert sorted(tuple(r.path) for r in graphs.cycles(df).collect()) == sorted(loops) and (2,) in loops


def test_constants_skip_dead_branches(spark):
    """x = 1; if x >= 1: y = 2 else: y = 3; z = y + x. A loop makes its variable many, a dead loop does not."""
    edges = [("a", 0, 1, ""), ("a", 1, 2, "true"), ("a", 1, 3, "false"), ("a", 2, 4, ""), ("a", 3, 4, ""), ("a", 4, 5, "")]
    sets = [("a", 0, 0, None, None, 1), ("a", 2, 1, None, None, 2), ("a", 3, 1, None, None, 3), ("a", 4, 2, 0, 1, 0)]
    tests = [("a", 1, 0, 1)]
    edges += [("b", 0, 1, ""), ("b", 1, 1, "true"), ("b", 1, 2, "false")]
    sets += [("b", 1, 0, 0, None, 1)]
    tests += [("b", 1, 0, -5)]
    edges += [("c", 0, 1, "true"), ("c", 0, 2, "false"), ("c", 1, 0, ""), ("c", 2, 3, "")]
    sets += [("c", 1, 0, 0, None, 1), ("c", 2, 1, 0, None, None)]
    tests += [("c", 0, 0, 1)]
    begin = [("a", 0, 0, 9), ("a", 0, 1, 9), ("a", 0, 2, 9), ("b", 0, 0, 0), ("c", 0, 0, 0), ("c", 0, 1, 4)]
    values, opened = constants.constants(
        spark.createDataFrame(edges, "proc string, src int, dst int, label string"), spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "proc string, node int"),
        spark.createDataFrame(sets, "proc string, node int, var int, left int, right int, plus int"), spark.createDataFrame(tests, "proc string, node int, var int, least int"), spark.createDataFrame(begin, "proc string, node int, var int, value int"),
    )
    at = {(r.proc, r.node, r["var"]): r.value for r in values.collect()}
    assert (at["a", 4, 1], at["a", 5, 2], at["b", 1, 0], at["c", 2, 0], at["c", 3, 1]) == (2, 3, None, 0, None)
    assert ("a", 3, 0) not in at and ("c", 1, 0) not in at
    open_edges = {tuple(r) for r in opened.collect()}
    assert ("a", 1, 3, "false") not in open_edges and ("a", 3, 4, "") not in open_edges and ("b", 1, 2, "false") in open_edges and ("c", 0, 1, "true") not in open_edges


@pytest.mark.parametrize("seed", [1])
def test_greedy_rounds_equal_the_loop(spark, seed):
    r = random.Random(seed)
    wants = [(p, r.randrange(6), frozenset(r.sample(range(30), r.randint(1, 3)))) for p in range(150)]
    used, want = set(), []
    for p, _, things in sorted(wants, key=lambda w: (w[1], w[0])):
        if not things & used:
            used |= things
            want.append((p,))
    df = spark.createDataFrame([(p, rank, t, "x") for p, rank, things in wants for t in things] * 2 + [(None, 0, 1, "x"), (1, 0, None, "x")], "proposal int, rank int, thing int, other string")
    assert rows(matching.greedy_disjoint(df)) == sorted(want, key=str)
    assert matching.greedy_disjoint(df.limit(0)).count() == 0


def test_one_to_one_of_a_hot_key(spark):
    """All pairs in one key, in order and nearest first, with ties."""
    r = random.Random(9)
    pairs = sorted({(r.randrange(40), r.randrange(40)) for _ in range(300)})
    for rank in ([], ["gap"]):
        left, right, want = set(), set(), set()
        for a, b in sorted(pairs, key=lambda p: (abs(p[0] - p[1]) if rank else 0, *p)):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.add(("k", a, b))
        df = spark.createDataFrame([("k", a, b, abs(a - b)) for a, b in pairs], "key string, left int, right int, gap int")
        assert set(map(tuple, matching.one_to_one(df, ["key"], rank).select("key", "left", "right").collect())) == want


@pytest.mark.parametrize("widths", [(0, 0), (0, 3), (5, 2000), (1, 100_000)])
def test_overlaps_of_mixed_widths(spark, widths):
    r = random.Random(sum(widths))
    span = lambda w: (lambda a: (a, a + r.choice([0, 1, w // 2, w])))(r.randrange(-500, 3000))
    left = [(i, r.choice("kkkm"), *span(widths[0])) for i in range(200)] + [(900, "k", None, 4), (901, "k", 9, 3), (902, None, 1, 2)]
    right = [(i, r.choice("kkkm"), *span(widths[1])) for i in range(200)] + [(903, "k", 5, None), (904, "k", 9, 3)]
    want = sorted((i, j) for i, k, a, b in left for j, m, c, d in right if k == m and k is not None and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b)
    x, y = spark.createDataFrame(left, "i int, key string, a int, b int"), spark.createDataFrame(right, "j int, key string, c long, d long")
    both = intervals.overlap_join(x, y, ["key"], ("a", "b"), ("c", "d"))
    assert sorted((r.i, r.j) for r in both.collect()) == want and sorted(both.columns) == sorted("i key a b j c d".split())
    semi = intervals.overlap_join(x, y, ["key"], ("a", "b"), ("c", "d"), "left_semi")
    assert sorted(r.i for r in semi.collect()) == sorted({i for i, _ in want}) and semi.columns == x.columns


def test_where_paths_move(spark):
    """The rule of moved() against lists of selectors."""
    r = random.Random(4)
    path = lambda n: [r.choice(["a", "b", "ab", "0"]) for _ in range(r.randint(0, n))]
    cases = [(path(7), path(3), path(3)) for _ in range(800)]
    dotted = ".".join
    df = spark.createDataFrame([(i, dotted(p), dotted(s), dotted(t)) for i, (p, s, t) in enumerate(cases)], "i int, path string, source string, target string")
    rule = views.dialect(access_paths.moved("path", "source", "target"), 0)
    got = {x.i: (x.below, x.to) for x in df.selectExpr("i", f"{access_paths.below('path', 'source')} AS below", f"{rule} AS to").collect()}
    for i, (p, s, t) in enumerate(cases):
        at_or_below = p[: len(s)] == s
        assert got[i][0] == at_or_below
        assert got[i][1] == dotted((t + p[len(s) :])[: access_paths.DEEPEST] if at_or_below else t), cases[i]


def test_recursive_structures_end(spark):
    """x.next = x for ever: the path is cut where selectors are no longer told apart."""
    taints = spark.createDataFrame([(1, 0, "v", 0)], "scope int, var int, path string, stratum int")
    moves = spark.createDataFrame([(1, 0, 0, "n", 0, "")], "scope int, stratum int, var int, path string, from_var int, from_path string")
    got = access_paths.access_paths(taints, moves, views.dialect(access_paths.moved("path", "from_path", "to_path"), 0))
    assert {r.path for r in got.collect()} == {"v", "n.v", "n.n.v", "n.n.n.v", "n.n.n.n.v", "n.n.n.n.n"}


def test_sketches_of_parts_equal_those_of_the_whole(spark):
    df = spark.range(60_000).selectExpr("id % 3 AS tool", "id % 200 AS day", "id % 7000 AS place", "id % 997 AS amount", "CAST(pow(id % 64, 2) % 20 AS INT) AS rule")
    make = lambda rows, groups: sketches.sketched(rows, groups, F.col("place"), F.col("amount"), F.col("rule"))
    parts = make(df.filter("day < 90"), ["tool", "day"]).unionByName(make(df.filter("day >= 90"), ["tool", "day"]))
    rolled = {r.tool: r for r in sketches.estimated(sketches.rolled_up(parts, ["tool"]), ["tool"]).collect()}
    whole = {r.tool: r for r in sketches.estimated(make(df, ["tool"]), ["tool"]).collect()}
    exact = {r.tool: r for r in df.groupBy("tool").agg(F.count_distinct("place").alias("d")).collect()}
    for tool, r in rolled.items():
        assert r.n == whole[tool].n == 20_000
        assert r.distinct_places == whole[tool].distinct_places  # the same registers
        assert abs(r.distinct_places - exact[tool].d) < 0.08 * exact[tool].d
        assert abs(r.p50 - 498) < 40 and abs(r.p95 - 947) < 40
        assert [x["count"] for x in r.top] == [x["count"] for x in whole[tool].top]
    assert sketches.rolled_up(parts, []).first().n == 60_000


@pytest.mark.parametrize("looped", [1_000_000, 40])
def test_one_to_one_in_a_fixed_order_needs_no_rounds(spark, monkeypatch, looped):
    """A chain: each left takes the right that the one before left over. Rounds would follow one another along it; larger keys (and null ones) still go in them."""
    rows = [(key, i, j) for key, n in (("a", 12), ("b", 30), (None, 3)) for i in range(n) for j in (i, i + 1)]
    want = set()
    for key in ("a", "b", None):
        lefts, rights = set(), set()
        for k, i, j in sorted(((k, i, j) for k, i, j in rows if k == key), key=lambda r: r[1:]):
            if i not in lefts and j not in rights:
                lefts.add(i)
                rights.add(j)
                want.add((k, i, j))
    rounds = []
    plain = matching.greedy_disjoint
    monkeypatch.setattr(matching, "greedy_disjoint", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    monkeypatch.setattr(matching, "LOOPED", looped)
    df = spark.createDataFrame(rows, "key string, left int, right int")
    assert set(map(tuple, matching.one_to_one(df, ["key"], []).select("key", "left", "right").collect())) == want
    assert len(rounds) == (looped == 40)


def test_not_in_is_a_join_by_keys(spark):
    """No table of all keys goes through the driver; nulls count as in SQL."""
    rows = spark.createDataFrame([(1,), (2,), (None,), (2,)], "a int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for others, want in (([(1,), (3,)], [2, 2]), ([(1,), (None,)], [])):
            other = spark.createDataFrame(others, "b int")
            got = analyses._not_in(rows, "a", other, "b")
            rows.createOrReplaceTempView("rows_in"), other.createOrReplaceTempView("others_in")
            assert sorted(r.a for r in got.collect()) == want == sorted(r.a for r in spark.sql("SELECT a FROM rows_in WHERE a NOT IN (SELECT b FROM others_in)").collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "HashedRelationBroadcastMode" not in plan
        heads = []
        reach = analyses.graphs.reachable
        analyses.graphs.reachable = lambda seeds, *a: heads.append(seeds) or reach(seeds, *a)
        try:
            analyses.heap_overlaps(spark, "/root/testdata/sf0.001")
        finally:
            analyses.graphs.reachable = reach
        assert "HashedRelationBroadcastMode" not in heads[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def facts_by_both_ways(spark, edges, starts, **given):
    """Flow facts in tasks, and by rounds of joins."""
    got = flow.flow_facts(edges, starts, **given)
    tables = [edges.withColumn("label", F.lit("")), starts, *(given.get(x) for x in ("gen", "kill", "at_start", "edge_gen", "edge_kill"))]
    return set(map(tuple, got.collect())), set(map(tuple, flow._in_rounds(*tables, "both").collect()))


def test_procedures_of_a_bounded_size_need_no_rounds(spark, monkeypatch):
    """A chain of 200 nodes and a loop: no table a round; what is too large for a task goes in rounds, and both ways agree."""
    edges = [("a", i, i + 1) for i in range(200)] + [("b", 0, 1), ("b", 1, 0), ("b", 1, 2)]
    gen = [("a", i, i, i % 2) for i in range(0, 200, 2)] + [("b", 1, 7, 0)]
    frame = lambda data, names: spark.createDataFrame(data, "proc string, " + ", ".join(f"{x} int" for x in names.split()))
    given = {"gen": frame(gen, "node fact part"), "kill": frame([("a", 150, 0), ("b", 1, 0)], "node part"), "at_start": frame([("a", 0, -3, 1)], "node fact part")}
    links, starts = frame(edges, "src dst"), frame([("a", 0), ("b", 0)], "node")
    with monkeypatch.context() as m:
        m.setattr(flow, "_cut", None)
        found = set(map(tuple, flow.flow_facts(links, starts, **given).collect()))
    assert ("a", 200, 150, 0, True) in found and ("a", 200, 148, 0, True) not in found and ("b", 0, 7, 0, False) in found and ("a", 200, -3, 1, True) in found
    monkeypatch.setattr(whole, "MOST", 9)
    mixed, rounds = facts_by_both_ways(spark, links.filter("proc = 'b' OR src < 12"), starts, **given)
    assert mixed == rounds == {f for f in found if f[0] == "b" or f[1] <= 12}


def test_dominators_of_procedures_with_two_starts(spark):
    """A node that two starts reach has itself above it, though no other."""
    edges = spark.createDataFrame([(0, 0, 2), (0, 1, 2), (0, 2, 3)], "proc int, src int, dst int")
    got = flow.dominators(edges, spark.createDataFrame([(0, 0), (0, 1)], "proc int, node int"))
    assert set(map(tuple, got.collect())) == {(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 3, 2)}


def test_constants_in_tasks_and_in_rounds(spark, monkeypatch):
    """No table a round for procedures of a bounded size; both ways agree on branches, loops, sums beyond a long and what is not given."""
    r = random.Random(3)
    edges, sets, tests, begin = [], [], [], []
    for p in range(40):
        size = r.randint(2, 6)
        for n in range(size):
            if r.random() < 0.4:
                edges += [(p, n, n + 1, "true"), (p, n, r.randint(0, size), "false")]
                tests.append((p, n, r.randrange(3), r.choice([0, 1, 2, None])))
            else:
                edges.append((p, n, n + 1, "next"))
            if r.random() < 0.7:
                sets.append((p, n, r.randrange(3), r.choice([None, 0, 1]), r.choice([None, None, 2]), r.choice([0, 1, 2**63 - 1, None])))
        begin += [(p, 0, v, r.choice([0, 1, None])) for v in range(3) if r.random() < 0.8]
    frame = lambda data, names: spark.createDataFrame(data, ", ".join(f"{x} {'string' if x == 'label' else 'long' if x in ('plus', 'value', 'least') else 'int'}" for x in names.split()))
    given = [frame(edges, "proc src dst label"), frame([(p, 0) for p in range(40)], "proc node"), frame(sets, "proc node var left right plus"), frame(tests, "proc node var least"), frame(begin, "proc node var value")]
    want = [set(map(tuple, x.collect())) for x in constants._in_rounds(*given)]
    with monkeypatch.context() as m:
        m.setattr(constants, "_cut", None)
        both = constants.solved(*given)
        assert [set(map(tuple, both.filter("node IS NOT NULL").select("proc", "node", "var", "value").collect())), set(map(tuple, both.filter("src IS NOT NULL").select("proc", "src", "dst", "label").collect()))] == want
    monkeypatch.setattr(whole, "MOST", 14)
    assert [set(map(tuple, x.collect())) for x in constants.constants(*given)] == want


def test_rounds_follow_calls_not_statements(spark, monkeypatch):
    """A procedure of 40 steps that calls one of 40 steps: as many tables as for short ones; what is asked for alone is told."""
    written = []
    monkeypatch.setattr(tabulation, "_cut", lambda df, cut=tabulation._cut: written.append(1) or cut(df))
    flows = [(p, i, 1, i + 1, 1) for p in "ab" for i in range(40) if (p, i) != ("a", 20)]
    links = spark.createDataFrame(flows, "proc string, node int, fact int, to_node int, to_fact int")
    entered, back = spark.createDataFrame([("a", 20, 1, "b", 0, 1)], CALLS), spark.createDataFrame([("a", 20, "b", 40, 1, 21, -1), ("a", 20, "b", 40, 1, 21, 1)], RETURNS)
    starts = spark.createDataFrame([("a", 0, 1)], "proc string, node int, fact int")
    got = set(map(tuple, tabulation.tabulate(links, entered, back, starts).collect()))
    assert got == {(p, 1, i, 1) for p in "ab" for i in range(41)} | {("a", 1, 21, -1)} and len(written) <= 15
    tell = spark.createDataFrame([("a", 40, 1), ("a", 21, -1), ("b", 40, 7)], "proc string, node int, fact int")
    assert rows(tabulation.tabulate(links, entered, back, starts, tell)) == [("a", 1, 21, -1), ("a", 1, 40, 1)]


def linked(spark, edges, alone=()):
    after = {a: [] for a in alone}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    return spark.createDataFrame([*after.items(), (None, [1])], "node long, next array<long>").repartition(3)


@pytest.mark.parametrize(("most", "leaves"), [(2000, False), (6, False), (2000, True)])
def test_graphs_whole_in_tasks(spark, monkeypatch, most, leaves):
    """Parts and cycles of many graphs at once without a write to the shared folder; larger graphs, and edges between graphs, go in rounds."""
    monkeypatch.setattr(whole, "MOST", most)
    r = random.Random(most)
    edges = [(1000 * g + r.randrange(n), 1000 * g + r.randrange(n)) for g, n in enumerate([1, 2, 3, 5, 7, 4]) for _ in range(2 * n)] + ([(3001, 4002), (4002, 3001)] if leaves else [])
    edges += [(9000, None), (9000, 9000)] + ([] if most < 100 or leaves else [(8000 + i, 8000 + (i + 1) % 150) for i in range(150)])
    real = [e for e in edges if None not in e]
    far = {a: reach(real, a) for a in {x for e in real for x in e}}
    df = linked(spark, edges, [9007])
    if (most, leaves) == (2000, False):
        monkeypatch.setattr(graphs, "_cut", None)
    got = rows(whole_graphs.strong_components(df, "{0} div 1000"))
    assert got == sorted([(a, max(b for b in far[a] if a in far[b])) for a in {a for a, _ in edges}] + [(9007, 9007)], key=str)

    def ways(path):
        yield path
        for a, b in set(real):
            if a == path[-1] and b > path[0] and b not in path:
                yield from ways([*path, b])

    loops = [w for s in far for w in ways([s]) if (w[-1], s) in real]
    assert sorted(list(x.path) for x in whole_graphs.cycles(df, "{0} div 1000").collect()) == sorted(loops)


@pytest.mark.parametrize("extra", [0, 25])
def test_far_nodes_take_few_rounds(spark, monkeypatch, extra):
    """A way of 3,000 nodes that closes, with some other ways beside it: nearest depths, in rounds that grow with the logarithm."""
    n, r = 3000, random.Random(extra)
    edges = [(i, i + 1) for i in range(n - 1)] + [(n - 1, 7)] + [(r.randrange(n), r.choice([r.randrange(n), n + i])) for i in range(extra)] + [(n - 5, None)] * bool(extra)
    after, depth, todo = {}, {0: 0, None: None}, [0]
    for a, b in edges:
        after.setdefault(a, []).append(b)
    for a in todo:
        for b in after.get(a, []):
            if depth.get(b) is None:
                depth[b] = depth[a] + 1
                todo += [b] if b is not None else []
    want = {k: d for k, d in depth.items() if d is not None}
    writes, cut = [], fixpoint._cut
    monkeypatch.setattr(fixpoint, "_cut", lambda df: writes.append(1) or cut(df))
    got = fixpoint.far_reachable(spark.createDataFrame([(0,)], "node long"), spark.createDataFrame(edges * 2, "src long, dst long")).collect()
    assert {x.node: x.depth for x in got} == want and len(got) == len(want)
    assert extra or len(writes) < 40


@pytest.mark.parametrize("most", [2000, 12])
def test_paths_whole_in_tasks(spark, monkeypatch, most):
    """Tainted paths of many scopes at once against a plain loop, nulls included; small scopes write no rounds."""
    monkeypatch.setattr(whole, "MOST", most)
    r = random.Random(8)
    path = lambda: ".".join(r.choice("ab") for _ in range(r.randint(0, 3)))
    var = lambda: r.choice([0, 1, 2, None])
    taints = [(s, var(), path(), r.randrange(3)) for s in range(30) for _ in range(2)] + [(None, 1, "a", 2)]
    moves = [(s, r.randrange(3), var(), path(), var(), path()) for s in [*range(30), None] for _ in range(r.choice([1, 3, 20 if s and s > 27 else 5]))]
    want = {}
    todo = list(taints)
    for s, v, p, at in todo:
        if want.get((s, v, p), 9) > at:
            want[s, v, p] = at
            for q, when, to_var, to_path, from_var, from_path in moves:
                a, b, c = (x.split(".") if x else [] for x in (p, from_path, to_path))
                if None not in (s, v) and (s, v) == (q, from_var) and at <= when and (a[: len(b)] == b or b[: len(a)] == a):
                    todo.append((s, to_var, ".".join((c + a[len(b) :])[: access_paths.DEEPEST] if a[: len(b)] == b else c), when))
    given = spark.createDataFrame(taints, "scope int, var int, path string, stratum int"), spark.createDataFrame(moves, "scope int, stratum int, var int, path string, from_var int, from_path string")
    if most == 2000:
        monkeypatch.setattr(access_paths, "_cut", None)
    got = access_paths.access_paths(*given, views.dialect(access_paths.moved("path", "from_path", "to_path"), 0))
    assert rows(got) == sorted([(*k, at) for k, at in want.items()], key=str) and got.schema["var"].dataType.simpleString() == "int"


def test_states_of_calls_against_a_plain_loop(spark):
    """Statements that branch, loop, return early and call, themselves included and procedures that are not there, with far fewer rows than a step of each fact has."""
    r, stmts = random.Random(11), []
    for proc in range(120):
        size = r.randint(1, 9)
        for node in range(1, size + 1):
            stmts.append((proc, node, size, r.choice([*whole_calls.OPS, "call", "call", "source"]), r.randrange(4), r.randrange(4), r.randrange(-3, 50), r.randrange(-5, 130)))
    # a chain of wrappers around one that frees its argument
    stmts += [(p, 1, 1, *(("call", 2, 0, 0, p + 1) if p < 207 else ("free", 0, 0, 0, 0))) for p in range(200, 208)]
    of = {(s[0], s[1]): s[2:] for s in stmts}
    sizes = {s[0]: s[2] for s in stmts}
    path = {(p, g, 1, g) for p in sizes for g in (-1, 0)}

    def grown():
        ends = {}
        for p, g, n, f in path:
            if n == sizes[p] + 1:
                ends.setdefault((p, g), set()).add(f)
        for p, g, n, f in path:
            if n > sizes[p]:
                continue
            size, op, tgt, src, val, callee = of[p, n]
            out = set() if op in ("source", "const", "copy", "add", "call") and tgt == f else {f}
            out |= {tgt} if (op in ("copy", "add") and f == src) or (op == "source" and f == -1) else set()
            out |= {9} if op == "free" and f == tgt else set()
            if op == "call":
                for e in [-1] * (f == -1) + [0] * (f == src):
                    out |= {tgt if x == 1 else 9 for x in ends.get((callee, e), ()) if x in (1, 9)}
            step = abs(val) % 3 * (1 if val > 0 else -1)
            to = [size + 1 if op == "return" else n + 1] + [min(n + 2 + step, size + 1)] * (op == "branch") + [max(1, n - step)] * (op == "loop")
            yield from ((p, g, t, x) for t in to for x in out if t <= size + 1)

    while more := set(grown()) - path:
        path |= more
    place = {-1: 0, 0: 1, 1: 2, 2: 3, 3: 4, 9: 5}
    want = dict.fromkeys(sizes, 0)
    for p, g, n, f in path:
        want[p] |= 1 << place[f] + 6 * (g == 0) if n == sizes[p] + 1 else 0
    df = spark.createDataFrame(stmts, "proc long, node int, size int, op string, tgt int, src int, val int, callee long").repartition(4)
    assert whole_calls.fits(df) and not whole_calls.fits(df.withColumn("tgt", F.expr("tgt - 1"))) and not whole_calls.fits(df.withColumn("val", F.expr("nullif(val, 3)")))
    held = whole_calls.states(df)
    assert {x.proc: x.held for x in held.collect()} == want and want[200] >> 11 & 1
    # from procedures that none calls on
    entered, todo = set(), [(p, -1) for p in sizes if p not in {s[7] for s in stmts if s[3] == "call"}]
    starts = spark.createDataFrame([(p,) for p, _ in todo], "proc long")
    while todo:
        entered.add(now := todo.pop())
        for p, g, n, f in path:
            if (p, g) == now and n <= sizes[p] and of[p, n][1] == "call" and of[p, n][5] in sizes:
                todo += [(of[p, n][5], e) for e in [-1] * (f == -1) + [0] * (f == of[p, n][3]) if (of[p, n][5], e) not in entered]
    sinks = {(p, n, f) for p, g, n, f in path if (p, g) in entered and n <= sizes[p] and of[p, n][1] == "sink" and of[p, n][3] == f}
    assert set(map(tuple, whole_calls.reached_sinks(df, held, starts).collect())) == sinks and sinks
