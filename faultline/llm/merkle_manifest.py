"""A Merkle manifest of a dataset with a proof for every row, by a broadcast upper tree.

Rows become leaves (32 bytes and a few columns; texts never move), get their place by doc_id from a range partitioning, and meet
in blocks of 2 ** BITS consecutive leaves. Each block is reduced to one node by a task; further rounds of blocks follow until at
most TOP nodes are left. The driver makes the tree above them and broadcasts the path of each node to the root; tasks then give
each row of a block its whole proof and fold it.

H is the hex sha256 of its inputs put together, digests as hex text. A leaf is H of doc_id, source, lang, n_chars and text, each
"-" if null, else the number of its UTF-8 bytes, ":" and the value. Leaves of a lang ascend by doc_id (null first; rows alike in
it by their leaves, so that repeated rows in any order give one tree); two consecutive nodes become H of both, a last single one H
of itself, while there is more than one. The roots of the langs, null first, then bytewise, are reduced likewise to the root.

Defined results: an empty text has a length of 0; a null doc_id is never tampered with; a text of any length is one leaf; one
leaf alone is its lang's root, one lang's root is the root; other columns are not read; an empty table gives an empty one. What
the driver holds and broadcasts is at most TOP nodes with paths, whatever the number of rows or langs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .variant_groups import CRC_OF_HEX, CRC_TABLE

#: A block is 2 ** BITS leaves; the driver takes over at TOP nodes.
BITS, TOP = 12, 8192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Where a row is tampered with: 7 divides crc32 of its doc_id.
TAMPERED = 7


def _field(c):
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, tampered (the leaf with one more in n_chars, null where the row is not tampered with), row."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("long" if c == "n_chars" else "string").alias(c) for c in FIELDS[1:]))
    leaf = lambda **changed: F.sha2(F.concat(*(_field(changed.get(c, F.col(c))) for c in FIELDS)), 256)
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % TAMPERED == 0
    tree = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), "lang"))
    tampered = F.when(hit, leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))
    return typed.select(tree.alias("tree"), "doc_id", leaf().alias("leaf"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("row"))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place (idx) in their tree by the order, and the tree's size (n). Rows are dealt by ranges of the whole order,
    so a large tree spans many tasks; only counts of (tree, task) are summed up over tasks."""
    sort = ["tree", *order]
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    dealt = written(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    count = dealt.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("at").alias("low"))
    by_part = Window.partitionBy("tree").orderBy("part")
    count = count.withColumn("n", F.sum("c").over(Window.partitionBy("tree"))).withColumn("before", F.sum("c").over(by_part) - F.col("c"))
    count = written(count.drop("c"), f"{name}-counts")
    return dealt.join(count, ["tree", "part"]).withColumn("idx", F.col("at") - F.col("low") + F.col("before")).drop("part", "at", "low", "before")


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lifted(nodes: list[str], height: int) -> list[list[str]]:
    """The levels above nodes, nodes first."""
    levels = [nodes]
    for _ in range(height):
        nodes = [hashed(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def path_of(levels: list[list[str]], i: int) -> list[str]:
    """A step for each level under the last: which side the sibling is on (L or R), and its digest, or nothing where there is none."""
    out = []
    for nodes in levels[:-1]:
        at = i ^ 1
        out.append(("L" if i & 1 else "R") + (nodes[at] if at < len(nodes) else ""))
        i >>= 1
    return out


def folded(digest: str, path: list[str]) -> str:
    for step in path:
        digest = hashed(step[1:], digest) if step[0] == "L" else hashed(digest, step[1:])
    return digest


def height_of(n: int, bits: int) -> int:
    """Levels of a block in a tree of n nodes."""
    return min(bits, (int(n) - 1).bit_length())


NODE = "tree string, idx long, n long, digest string"
PATH = "tree string, idx long, path string, subroot string"


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """One node for each block of nodes (tree, idx, n, digest)."""

    def reduce(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["n"].iloc[0])
        digest = lifted(part.sort_values("idx")["digest"].tolist(), height_of(n, bits))[-1][0]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-n >> bits) if n > 1 << bits else 1], "digest": [digest]})

    return nodes.groupBy("tree", F.shiftright("idx", bits).alias("block")).applyInPandas(reduce, NODE)


def _top(nodes: list, merged: bool) -> tuple[dict, str]:
    """The path of each of the last nodes and the root. Of merged trees the nodes are the langs' own, so no subroot lies above them."""
    if not nodes:
        return {}, ""
    trees: dict[str, list] = {}
    for r in sorted(nodes, key=lambda r: (r.tree.encode(), r.idx)):
        trees.setdefault(r.tree, []).append(r.digest)
    levels = {tree: lifted(own, height_of(len(own), 64)) for tree, own in trees.items()}
    upper = lifted([own[-1][0] for own in levels.values()], height_of(len(levels), 64))
    paths = {}
    for at, (tree, own) in enumerate(levels.items()):
        above = path_of(upper, at)
        for i in range(len(own[0])):
            paths[tree, i] = ",".join(path_of(own, i) + above), None if merged else own[-1][0]
    return paths, upper[-1][0]


ROW = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, bits: int = BITS, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, for each row of docs."""
    bottom = placed(written(leaves(docs), "merkle-leaves"), ["doc_id", "leaf", "row"], "merkle-placed").withColumnRenamed("leaf", "digest")
    bottom = bottom.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no long with nulls
    levels, merged = [], False  # levels: nodes (tree, idx, n, digest) with the names that the level below knows them by; are they the langs' roots
    nodes = bottom
    while True:
        blocks = written(_blocks(nodes.select("tree", "idx", "n", "digest"), bits), "merkle-blocks")
        if blocks.limit(top + 1).count() <= top:
            break
        if not merged and blocks.filter("n > 1").isEmpty():  # more langs than the driver takes: their roots go on as one tree
            merged = True
            langs = blocks.select(F.lit("").alias("tree"), F.col("tree").alias("under"), "digest").withColumn("under_idx", F.lit(0).cast("long"))
            nodes = placed(langs, ["under"], "merkle-langs")
            levels.append((nodes, True))
        else:
            nodes = blocks.withColumn("under", F.col("tree")).withColumn("under_idx", F.col("idx"))
            levels.append((nodes, False))
    paths, root = _top(blocks.collect(), merged)
    shared = docs.sparkSession.sparkContext.broadcast(paths)
    above = None  # the paths of the blocks of a level, where they are a table

    def passed_on(langs: bool):
        def finish(block, part: pd.DataFrame, path) -> pd.DataFrame:
            path, subroot = path or shared.value[block]
            told = list(_suffixes(part, bits, path))
            subroots = part["digest"].tolist() if langs else [subroot] * len(part)
            return pd.DataFrame({"tree": part["under"].tolist(), "idx": part["under_idx"].tolist(), "path": [",".join(p) for p in told], "subroot": subroots})

        return finish

    for nodes, langs in reversed(levels):
        above = written(_finished(nodes, bits, above, passed_on(langs), PATH), "merkle-paths")

    def proved(block, part: pd.DataFrame, path) -> pd.DataFrame:
        path, subroot = path or shared.value[block]
        out = []
        for steps, doc, leaf, tampered in zip(_suffixes(part, bits, path), part["doc_id"], part["digest"], part["tampered"], strict=True):
            end = folded(tampered or leaf, steps)
            out.append((doc, leaf, subroot, root, hashed(*(s[1:] for s in steps)), end, end == root))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])

    return _finished(bottom, bits, above, proved, ROW).withColumn("doc_id", F.col("doc_id").cast("long"))


def _suffixes(part: pd.DataFrame, bits: int, path: str) -> Iterator[list[str]]:
    """The whole path of each node of a block, in order; path is that of the block."""
    digests = part["digest"].tolist()
    levels = lifted(digests, height_of(part["n"].iloc[0], bits))
    above = path.split(",") if path else []
    return (path_of(levels, i) + above for i in range(len(digests)))


def _finished(nodes: DataFrame, bits: int, paths: DataFrame | None, finish, schema: str) -> DataFrame:
    """finish() over each block of nodes, with the block's path and subroot: from the broadcast, or from the table that the level above left."""
    dealt = nodes.withColumn("block", F.shiftright("idx", bits)).groupBy("tree", "block")

    def alone(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return finish((key[0], int(key[1])), part.sort_values("idx"), None)

    if paths is None:
        return dealt.applyInPandas(alone, schema)

    def joined(key: tuple, part: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        return finish((key[0], int(key[1])), part.sort_values("idx"), (path["path"].iloc[0], path["subroot"].iloc[0]))

    return dealt.cogroup(paths.withColumnRenamed("idx", "block").groupBy("tree", "block")).applyInPandas(joined, schema)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"


def _sql_leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_sql_field(n_chars if c == 'n_chars' else c) for c in FIELDS)})"


ORACLE = f"""WITH RECURSIVE crc AS ({CRC_TABLE}),
  leaf AS (SELECT doc_id, tree, leaf, CASE WHEN {CRC_OF_HEX.format("x")} % {TAMPERED} = 0 THEN tampered ELSE leaf END AS start, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
    FROM (SELECT doc_id, hex(encode(CAST(doc_id AS VARCHAR))) AS x, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, {_sql_leaf("n_chars")} AS leaf, {_sql_leaf("(n_chars + 1)")} AS tampered FROM documents) d, crc),
  node AS (SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM leaf UNION ALL SELECT tree, lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY tree, lvl, idx // 2),
  sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
  up AS (SELECT 0 AS lvl, idx, n, subroot AS h FROM sub UNION ALL SELECT lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY lvl, idx // 2),
  walk AS (SELECT doc_id, leaf, tree, 0 AS lvl, idx, n, start AS cur, '' AS proof FROM leaf
    UNION ALL SELECT w.doc_id, w.leaf, w.tree, w.lvl + 1, w.idx // 2, (w.n + 1) // 2, sha256(CASE WHEN w.idx % 2 = 1 THEN s.h || w.cur ELSE w.cur || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
    FROM walk w LEFT JOIN node s ON s.tree = w.tree AND s.lvl = w.lvl AND s.idx = xor(w.idx, 1) WHERE w.n > 1),
  climb AS (SELECT w.doc_id, w.leaf, s.subroot, 0 AS lvl, s.idx, s.n, w.cur, w.proof FROM walk w JOIN sub s ON w.tree = s.tree WHERE w.n = 1
    UNION ALL SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.idx // 2, (c.n + 1) // 2, sha256(CASE WHEN c.idx % 2 = 1 THEN s.h || c.cur ELSE c.cur || coalesce(s.h, '') END), c.proof || coalesce(s.h, '')
    FROM climb c LEFT JOIN up s ON s.lvl = c.lvl AND s.idx = xor(c.idx, 1) WHERE c.n > 1)
  SELECT c.doc_id, c.leaf, c.subroot, u.h AS root, sha256(c.proof) AS proof_sha256, c.cur AS folded_root, c.cur = u.h AS verified FROM climb c, up u WHERE c.n = 1 AND u.n = 1"""
