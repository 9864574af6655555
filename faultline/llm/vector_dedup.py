"""Operator 6. Near-duplicate vectors by a robust-pruned flat graph.

Vectors link when their labels are equal and their cosine, in double precision, reaches the threshold. Equal vectors are one
point with a weight. A point of a label is at home in the cell of its nearest center (k-means on a sample of about
SAMPLE vectors, of 64 a label at least; a label of at most CELL points is one cell); a cell beyond SLICE times CELL points is
dealt into slices by a hash. In each slice a flat graph is built: nearest candidates, pruned so that
an edge goes where no kept neighbour is ALPHA times closer.
Cells overlap by their queries: each point is one in every cell that can be home to a vector within the threshold, nearer the
border to its own cell than such a vector can be away. So each end of a link finds the other at home, once, and graphs hold no copies.
In the slice where it is at home, a query is a beam search from one point of each component of the graph, the medoid and
the point, then range expansion through all points within SLACK of the threshold; AUDIT such queries are compared with a full
scan; if fewer than AUDITED of their links were found, the slice is searched again with twice the beam and slack, and if no
beam helps, it is scanned. In other slices a query is compared with all points, in blocks.

Links leave a slice as counts and as a spanning forest, never as all pairs.

Nulls: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing;
vectors of other lengths do not compare. A null vec_id counts as a vector but never names a component unless alone (then
null, not kept). Rows with one vec_id are vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written
from .components import connected_components

COSINE = 0.93
CELL, SLICE = 2048, 3
SAMPLE, CENTERS = 20_000, 512
CANDIDATES, DEGREE, ALPHA = 96, 24, 1.2
BEAM, SLACK = 32, 0.08
AUDIT, AUDITED = 32, 0.99


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def centers_of(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    g = np.random.default_rng(seed)
    c = rows[g.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds if len(c) > 1 else 0):
        own = np.argmax(rows @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def cells_of(v: np.ndarray, centers: np.ndarray, cosine: float) -> tuple[list[int], list[int]]:
    """The nearest cell, home; and all that can be home to a vector whose cosine to v reaches the threshold, home among them.
    Such a vector is at most an angle of arccos(cosine) away, and not nearer the home of v than its own center."""
    sims = centers @ v
    home = int(np.argmax(sims))
    apart = np.linalg.norm(centers[home] - centers, axis=1)
    reach = np.sqrt(max(0.0, 1 - cosine * cosine)) if cosine > 0 else 1.0
    ask = np.flatnonzero(sims[home] - sims <= reach * apart + 1e-9)
    return [home], ask.tolist()


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists. A candidate is kept unless a kept, nearer neighbour is closer to it than its distance from the point over ALPHA."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    out = []
    for b in range(0, n, 512):
        sims = x[b : b + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(b, b + len(sims))] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(sims), 0), np.int64)
        for row, cand in zip(sims, near, strict=True):
            cand = cand[np.argsort(-row[cand], kind="stable")]
            away = np.sqrt(np.maximum(0, 2 - 2 * row[cand]))
            between = np.sqrt(np.maximum(0, 2 - 2 * (x[cand] @ x[cand].T)))
            alive, kept = np.ones(len(cand), bool), []
            for i in range(len(cand)):
                if alive[i]:
                    kept.append(i)
                    if len(kept) == DEGREE:
                        break
                    alive &= ALPHA * between[i] > away
            out.append(cand[kept])
    return out


def scan(x: np.ndarray, queries: np.ndarray, threshold: float) -> np.ndarray:
    """What a search in x is to find, a row of marks for each query, by comparing everything, in blocks."""
    out = np.zeros((len(queries), len(x)), bool)
    for b in range(0, len(queries), 512):
        np.greater_equal(queries[b : b + 512] @ x.T, threshold, out=out[b : b + 512])
    return out


class SliceSearch:
    def __init__(self, x: np.ndarray, adjacency: list[np.ndarray]):
        self.x = x
        # padded lists; a point's own place fills its list up. Edges are walked both ways.
        back: list[list[int]] = [[] for _ in adjacency]
        for i, a in enumerate(adjacency):
            for j in a.tolist():
                if len(back[j]) < 2 * DEGREE:
                    back[j].append(i)
        lists = [np.unique(np.concatenate([a, np.array(b, np.int64)])) if len(a) or b else np.array([i]) for i, (a, b) in enumerate(zip(adjacency, back, strict=True))]
        self.width = max([1, *map(len, lists)])
        self.near = np.array([np.pad(a, (0, self.width - len(a)), constant_values=i) for i, a in enumerate(lists)], np.int64).reshape(len(lists), self.width)
        self.medoid = int(np.argmax(x @ x.sum(0))) if len(x) else 0
        self.starts = np.unique(np.append(self._components(), self.medoid)) if len(x) else np.zeros(0, np.int64)

    def _components(self) -> np.ndarray:
        """The least point of each component of the graph."""
        label = np.arange(len(self.near))
        while True:
            new = np.minimum(label, label[self.near].min(1))
            np.minimum.at(new, self.near, label[:, None])
            new = new[new]
            if (new == label).all():
                return np.unique(label)
            label = new

    def within(self, q: np.ndarray, own: int | None, threshold: float, beam: int, slack: float) -> np.ndarray:
        """Points found with a cosine of at least threshold to q."""
        seen = np.zeros(len(self.x), bool)
        sims = np.full(len(self.x), -2.0)
        todo = self.starts if own is None else np.union1d(self.starts, [own])
        pool = todo
        seen[todo] = True
        sims[todo] = self.x[todo] @ q
        spread = np.zeros(len(self.x), bool)
        while True:
            open_ = pool[~spread[pool]]
            if not len(open_):
                break
            spread[open_] = True
            new = np.unique(self.near[open_])
            new = new[~seen[new]]
            seen[new] = True
            sims[new] = self.x[new] @ q
            pool = np.concatenate([pool, new])
            best = pool if len(pool) <= beam else pool[np.argpartition(-sims[pool], beam - 1)[:beam]]
            pool = np.union1d(best, pool[sims[pool] >= threshold - slack])
        return np.flatnonzero(sims >= threshold)


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _graph(t: pa.Table) -> pa.Table:
    node = t.column("node").to_numpy()
    lists = pruned_graph(unit(_rows(t.column("vector"))))
    return pa.table({"node": pa.array(node), "near": pa.array([node[a].tolist() for a in lists], pa.list_(pa.int64()))})


def _search(cosine: float):
    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        node, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
        x = unit(_rows(t.column("vector")))
        base, ask = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = {int(v): i for i, v in enumerate(node[base])}
        own = np.array([place.get(int(v), -1) for v in node[ask]], np.int64)
        at_home = np.flatnonzero(own >= 0)
        hits = np.zeros((len(ask), len(base)), bool)
        searched = at_home[:0]
        if len(at_home):  # only the part of the queries at home has the graph
            near = t.column("near").to_pylist()
            index = SliceSearch(x[base], [np.array([place[v] for v in near[i] or () if v in place], np.int64) for i in base])
            beam, slack = BEAM, SLACK
            audit = at_home[np.unique(np.linspace(0, len(at_home) - 1, min(AUDIT, len(at_home))).astype(int))]
            exact = {i: set(np.flatnonzero(f).tolist()) for i, f in zip(audit.tolist(), scan(x[base], x[ask[audit]], cosine), strict=True)}
            while True:
                tried = {i: index.within(x[ask[i]], own[i], cosine, beam, slack) for i in exact}
                hit = sum(len(exact[i] & set(tried[i].tolist())) for i in exact)
                enough = hit >= AUDITED * sum(map(len, exact.values()))
                if enough or beam > len(base):
                    break
                beam, slack = 2 * beam, 2 * slack
            searched = at_home if enough else searched
            for i in searched.tolist():
                hits[i, tried[i] if i in tried else index.within(x[ask[i]], own[i], cosine, beam, slack)] = True
        scanned = np.setdiff1d(np.arange(len(ask)), searched)
        hits[scanned] = scan(x[base], x[ask[scanned]], cosine)
        square = np.ix_(at_home, own[at_home])
        hits[square] |= hits[square].T  # a link found from one side counts for both
        hits[at_home, own[at_home]] = False
        some = hits.any(1)  # a query without links leaves no row
        ask, hits = ask[some], hits[some]
        links = np.array([weight[base[row]].sum() for row in hits], np.int64)
        known, at = np.unique(node, return_inverse=True)
        least = np.arange(len(known))
        for a, row in zip(at[ask], hits, strict=True):
            groups = np.unique(least[np.append(at[base[row]], a)])
            if len(groups) > 1:
                least[np.isin(least, groups)] = groups[0]
        joined = np.setdiff1d(np.flatnonzero(least != np.arange(len(known))), at[ask])  # the other ends of links
        of = np.concatenate([at[ask], joined])
        return pa.table({"node": pa.array(known[of]), "links": pa.array(np.append(links, np.zeros(len(joined), np.int64))), "peer": pa.array(known[least[of]])})

    return run


def linked(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = "label IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vector, x -> x <> 0)"
    v = v.withColumn("node", F.when(F.expr(sound), F.xxhash64("label", "vector")))
    rows = written(v.select("vec_id", "node"), "vectors")
    points = v.filter("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight")).withColumn("dim", F.size("vector"))
    points = written(points, "points")

    #: Only labels of more than one cell need centers; each of them gets its share of the sample, by a hash and not by a sort.
    sizes = points.groupBy("label", "dim").count().filter(F.col("count") > CELL)
    n_large = sizes.count()
    part = F.greatest(F.lit(64.0), F.lit(SAMPLE / max(1, n_large))) / F.col("count") * 2**32
    drawn = points.join(sizes, ["label", "dim"]).filter(F.pmod(F.xxhash64("node"), F.lit(2**32)) < part).select("label", "dim", "count", "vector").collect() if n_large else []
    groups: dict = {}
    for r in drawn:
        groups.setdefault((r["label"], r["dim"]), (r["count"], []))[1].append(r["vector"])
    centers = {k: centers_of(unit(np.array(x)), int(min(CENTERS, -(-n // CELL)))) for k, (n, x) in groups.items()}
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches):
        known = shared.value
        for batch in batches:
            cells, homes, at = [], [], []
            for i, (label, dim, vector) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                c = known.get((label, dim))
                home, ask = cells_of(unit(np.array([vector]))[0], c, cosine) if c is not None else ([0], [0])
                for b in ask:
                    cells.append(f"{label}/{dim}/{b}")
                    homes.append(b == home[0])
                    at.append(i)
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(homes, pa.bool_()), part.column(0), part.column(2), part.column(3)], names=["cell", "home", "node", "vector", "weight"])

    placed = points.select("node", "label", "vector", "weight", "dim").mapInArrow(assign, "cell string, home boolean, node long, vector array<double>, weight long")
    placed = cells = written(placed, "placed")
    dealt = lambda n: F.greatest(F.lit(1), F.ceil(n / (SLICE * CELL)))
    slices = placed.groupBy("cell").agg(dealt(F.count_if("home")).alias("slices"), dealt(F.count("*")).alias("parts"))
    placed = placed.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices"))).withColumn("part", F.when(F.col("home"), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("node"), F.col("parts"))))
    lists = written(placed.filter("home").groupBy("cell", "slice").applyInArrow(_graph, "node long, near array<long>"), "adjacency")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    base = placed.filter("home").join(lists, "node", "left").withColumn("part", each("parts")).select("cell", "slice", "part", F.lit(0).alias("side"), "node", "vector", "weight", F.expr("CASE WHEN part = 0 THEN near END").alias("near"))
    ask = placed.withColumn("slice", each("slices")).select("cell", "slice", "part", F.lit(1).alias("side"), "node", "vector", "weight", F.lit(None).cast("array<long>").alias("near"))
    found = written(base.unionByName(ask).groupBy("cell", "slice", "part").applyInArrow(_search(cosine), "node long, links long, peer long"), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("others"))
    labels = written(connected_components(found, "node", "peer"), "labels")
    of_node = points.select("node", "weight").join(counts, "node", "left").join(labels, "node", "left").select("node", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "node").alias("group"))
    of_node = written(of_node, "links-of-points")
    for df in (cells, lists, found, labels, points):
        discard(df)
    out = rows.join(of_node, "node", "left")
    least = out.filter("group IS NOT NULL").groupBy("group").agg(F.min("vec_id").alias("least"))
    return out.join(least, "group", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("group").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: Brute force over all pairs of a label; components by reachability.
ORACLE = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
  sound AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
  links AS (SELECT a.i, b.i AS j, b.vec_id FROM sound a JOIN sound b ON a.label = b.label AND len(a.x) = len(b.x) AND a.i <> b.i WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
  reach AS (SELECT i, i AS j, vec_id FROM v UNION SELECT r.i, l.j, l.vec_id FROM reach r JOIN links l ON r.j = l.i),
  least AS (SELECT i, min(vec_id) AS component_id FROM reach GROUP BY i)
  SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.i = v.i) AS n_links, least.component_id, v.vec_id IS NOT NULL AND v.vec_id = least.component_id AS kept FROM v JOIN least ON v.i = least.i"""


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
