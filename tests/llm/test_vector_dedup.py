import numpy as np
import pytest

from faultline.llm import vector_dedup as V


def brute(rows):
    out, root = {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    units = []
    for _, v, label in rows:
        a = np.array(v if v else [np.nan], float)
        units.append(a / np.linalg.norm(a) if label is not None and np.isfinite(a).all() and a.any() else None)
    n = [0] * len(rows)
    for i, x in enumerate(units):
        for j in range(i):
            y = units[j]
            if x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y >= 0.93:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    for i, r in enumerate(rows):
        out[i] = r[0], n[i], least.get(find(i)), r[0] is not None and least[find(i)] == r[0]
    return sorted(out.values(), key=str)


def cases():
    g = np.random.default_rng(7)
    rows = []
    for label in (0, 1, None):
        for _ in range(30):
            center = g.normal(size=16)
            for _ in range(g.integers(1, 12)):
                rows.append((len(rows), (center + 0.3 * g.normal(size=16) * np.linalg.norm(center) / 4 * 0.5).tolist(), label))
    clump = g.normal(size=16)
    rows += [(len(rows) + i, (clump + 0.02 * g.normal(size=16)).tolist(), 1) for i in range(300)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(40)] + [(2100, [2 * x for x in rows[0][1]], 0)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] + [1.0] * 15, 0), (3003, [float("inf")] + [1.0] * 15, 0), (3004, [], 0), (3005, [1.0, 2.0], 0), (3006, [2.0, 4.0], 0), (None, rows[1][1], 0), (7, rows[1][1], 0)]
    return rows


@pytest.mark.parametrize("cell", [V.CELL, 100])
def test_equals_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(V, "CELL", cell)
    rows = cases()
    given = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = sorted((tuple(r) for r in V.linked(given).collect()), key=str)
    want = brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    links = sum(r[1] for r in want)
    assert 0.97 * links <= sum(r[1] for r in got) <= links
    assert sum(a == b for a, b in zip(got, want, strict=True)) > 0.97 * len(want)
    if cell == V.CELL and cell > 1000:
        assert got == want


def test_recall_on_the_given_embeddings(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in given.collect()]
    got = sorted((tuple(r) for r in V.linked(given).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert V.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pruning_keeps_near_and_far():
    g = np.random.default_rng(1)
    x = V.unit(g.normal(size=(300, 8)))
    lists = V.pruned_graph(x)
    assert max(map(len, lists)) <= V.DEGREE
    for i, a in enumerate(lists):
        sims = x @ x[i]
        sims[i] = -2
        assert int(np.argmax(sims)) in a


def test_clumps_without_edges_between_them(spark):
    """More near-equal vectors in each of two groups than candidates, so the pruned graph has no edge from one to the other."""
    g = np.random.default_rng(5)
    a, b, c = np.linalg.qr(g.normal(size=(64, 3)))[0].T
    b = 0.945 * a + np.sqrt(1 - 0.945**2) * b
    x = np.concatenate([a + 0.002 * g.normal(size=(200, 64)), b + 0.002 * g.normal(size=(200, 64)), c + 0.05 * g.normal(size=(1000, 64))])
    u = V.unit(x)
    sims = u @ u.T
    assert sims[:200, 200:400].min() > 0.935
    want = ((sims >= 0.93).sum(1) - 1).tolist()
    got = V.linked(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == want
    assert {r.component_id for r in got[:400]} == {0}


def test_no_link_is_lost_between_cells(spark, monkeypatch):
    """A label of many cells; every second vector has one near vector at a cosine of about 0.94."""
    monkeypatch.setattr(V, "CELL", 100)
    g = np.random.default_rng(9)
    x = V.unit(g.normal(size=(1500, 16)))
    away = g.normal(size=x.shape)
    away = V.unit(away - (away * x).sum(1, keepdims=True) * x)
    x = np.concatenate([x, 0.94 * x + np.sqrt(1 - 0.94**2) * away])
    want = ((x @ x.T >= 0.93).sum(1) - 1).tolist()
    got = V.linked(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == want


def test_cells_of_a_query_hold_every_near_vector():
    g = np.random.default_rng(2)
    x = V.unit(g.normal(size=(3000, 8)))
    centers = V.centers_of(x, 40)
    cells = [V.cells_of(v, centers, 0.93) for v in x]
    for i, j in np.argwhere(x @ x.T >= 0.93).tolist():
        assert cells[j][0][0] in cells[i][1]


def test_a_vector_goes_only_to_cells_that_can_hold_its_links(spark, monkeypatch):
    """Four far groups in one label of several cells: one row a vector, no copies of it in the graphs of other cells."""
    monkeypatch.setattr(V, "CELL", 50)
    placed = {}

    def keep(df, name):
        out = written(df, name)
        if name == "placed":
            placed["rows"], placed["homes"] = out.count(), out.filter("home").count()
        return out

    written = V.written
    monkeypatch.setattr(V, "written", keep)
    g = np.random.default_rng(4)
    x = np.concatenate([c + 0.01 * g.normal(size=(50, 16)) for c in np.eye(16)[:4]])
    want = ((V.unit(x) @ V.unit(x).T >= 0.93).sum(1) - 1).tolist()
    got = V.linked(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == want
    assert placed["homes"] == len(x)
    assert placed["rows"] < 2 * len(x)


def test_queries_without_links_leave_no_rows(spark, monkeypatch):
    """Scattered vectors, ten of them with one near vector: what the search gives follows the links, not the cells that are asked."""
    monkeypatch.setattr(V, "CELL", 50)
    found = []

    def keep(df, name):
        out = written(df, name)
        if name == "found":
            found.append(out.count())
        return out

    written = V.written
    monkeypatch.setattr(V, "written", keep)
    g = np.random.default_rng(11)
    x = V.unit(g.normal(size=(300, 32)))
    x = np.concatenate([x, x[:10] + 0.01 * g.normal(size=(10, 32))])
    want = ((V.unit(x) @ V.unit(x).T >= 0.93).sum(1) - 1).tolist()
    got = V.linked(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == want and sum(want) == 20
    assert found[0] <= 2 * sum(want)
