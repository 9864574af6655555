"""Operator 8. Near-duplicates by HyperMinHash.

A document's set holds its distinct k-word shingles. Each of REGISTERS buckets keeps the smallest hash that falls into it, as
a leading-zero count and MANTISSA bits. Bands of compressed registers, empty buckets filled from others by a fixed preference,
give candidate buckets; at a Jaccard similarity of 0.8 a pair shares none with a chance of 5e-7. Candidates whose
collision-corrected estimate is more than SIGMAS standard errors below the threshold go; the rest are compared on full sets.

Copies (equal sets) are one class from the start. Inside a band bucket, members are first compared with its smallest class.
In a bucket whose members do not all join by that, those outside its largest component are compared with all others, in blocks
of about BLOCK classes or BLOCK_BYTES of sets, only across components. So a group of near copies costs a comparison each and a
copy of a set for each block of those that stay apart from it, and no link between different components is left out.

Nulls and empty texts have empty sets: linked with nothing, n_shingles 0, component_id their own doc_id. A null doc_id counts
as a document but never as a component_id (null if its component has no other). Rows with one doc_id are documents of their
own. Documents of fewer than k words have their whole word sequence as the one shingle. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collect_garbage, discard, mix64, shingle_hashes, table, word_hashes, word_spans, written
from .components import connected_components

BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
SIGMAS = 5.0
BLOCK, BLOCK_BYTES = 1024, 4 << 20
EMPTY = np.uint16(0xFFFF)
_PREFERENCE = mix64(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(77)).reshape(REGISTERS, REGISTERS)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    words = word_hashes(data, *word_spans(data))
    if 0 < len(words) < k:
        return shingle_hashes(words, len(words))
    return np.unique(shingle_hashes(words, k))


def node_of(shingles: np.ndarray) -> int | None:
    """A 64-bit hash of a whole set; null for the empty one."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and mantissa of the smallest hash in each bucket; EMPTY where none falls."""
    if not len(shingles):
        return np.full(REGISTERS, EMPTY, np.uint16)
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    least = np.full(REGISTERS, 1 << 32, np.uint64)
    np.minimum.at(least, bucket.astype(np.int64), shingles & np.uint64(0xFFFFFFFF))
    with np.errstate(divide="ignore"):
        exponent = np.floor(np.log2(np.maximum(least, 1).astype(np.float64))).astype(np.int64)
    zeros = 31 - exponent
    shift = exponent - MANTISSA
    low = least.astype(np.int64)
    mantissa = np.where(shift >= 0, low >> np.maximum(shift, 0), low << np.maximum(-shift, 0)) & ((1 << MANTISSA) - 1)
    return np.where(least == 1 << 32, EMPTY, (zeros << MANTISSA | mantissa).astype(np.uint16)).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band. An empty bucket takes the register of the filled bucket that it prefers."""
    filled = regs != EMPTY
    if not filled.all():
        have, lack = np.flatnonzero(filled), np.flatnonzero(~filled)
        regs = regs.copy()
        regs[lack] = regs[have[_PREFERENCE[np.ix_(lack, have)].argmin(1)]]
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64) + np.uint64(0x51ED27)
        for column in regs.reshape(BANDS, ROWS).T.astype(np.uint64):
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + column)
    return key


#: Chance that two different minima of a bucket share a register, for minima spread as 1/size: half the mass has one leading zero more each.
_COLLISION = 2.0 ** -(MANTISSA + 1)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows, corrected for chance collisions, and the number of buckets that each rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(-1), 1)
    same = ((a == b) & used).sum(-1)
    return np.clip((same / n - _COLLISION) / (1 - _COLLISION), 0, 1), n


def may_reach(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """False where sizes rule out the threshold, or the estimate lies SIGMAS standard errors below it."""
    t = percent / 100
    est, n = estimate(a, b)
    fits = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    return fits & (est >= t - SIGMAS * np.sqrt(t * (1 - t) / n))


SKETCH = "doc_id long, n_shingles long, node long, registers binary"


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sizes, nodes, regs = [], [], []
                for text in part.column(1):
                    s = shingle_set(text.as_py(), k)
                    sizes.append(len(s))
                    nodes.append(node_of(s))
                    regs.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "node", "registers"])

    return run


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set size, node (a hash of the whole set: equal sets are one node) and registers."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_sketch(k), SKETCH)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            keys = [band_keys(np.frombuffer(r.as_py(), np.uint16)) for r in part.column(1)]
            nodes, sizes = (np.repeat(part.column(c).to_numpy(), BANDS) for c in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(nodes), pa.array(sizes)], names=["band", "node", "n_shingles"])


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _hopeful(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = batch.columns
                keep = may_reach(_stack(c[4]), _stack(c[5]), c[2].to_numpy(), c[3].to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([c[0], c[1]], names=["a", "b"]).filter(pa.array(keep))

    return run


def _across(percent: int):
    """Of a pair of blocks: links that join their components. Pairs go by falling estimate; those already joined, those that an earlier band holds and those that cannot reach the threshold are passed over, so at most a link for each row comes out."""

    def run(t: pa.Table) -> pa.Table:
        node, label, size, side = (t.column(c).to_numpy() for c in ("node", "label", "n_shingles", "side"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("shingles")]
        regs = _stack(t.column("registers"))
        keys = np.stack([band_keys(r).view(np.int64) for r in regs])
        band = int(np.flatnonzero((keys == np.int64(t.column("band")[0].as_py())).all(0))[0])
        one_block = t.column("kind")[0].as_py() == "among" and t.column("i")[0].as_py() == t.column("j")[0].as_py()
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if one_block else 1))
        hopes = []
        for x in left:
            y = right[label[right] != label[x]]
            y = y[node[y] > node[x]] if one_block else y
            y = y[~(keys[y, :band] == keys[x, :band]).any(1)] if len(y) else y
            y = y[may_reach(regs[x], regs[y], size[x], size[y], percent)] if len(y) else y
            if len(y):
                hopes.append(np.stack([-estimate(regs[x], regs[y])[0], np.full(len(y), x), y], 1))
        out: list[tuple[int, int]] = []
        hopes = np.concatenate(hopes) if hopes else np.zeros((0, 3))
        for x, y in hopes[np.lexsort((hopes[:, 2], hopes[:, 1], hopes[:, 0]))][:, 1:].astype(np.int64).tolist():
            p, q = find(int(label[x])), find(int(label[y]))
            if p != q and reaches(sets[x], sets[y], percent):
                root[max(p, q)] = min(p, q)
                out.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(t.as_py(), k) for t in part.column(1)]
                own = [node_of(s) == n for s, n in zip(sets, part.column(0).to_pylist(), strict=True)]  # a doc_id may stand for several texts
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"]).filter(pa.array(own, pa.bool_()))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [reaches(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _set_table(nodes: DataFrame, docs: DataFrame, sketch: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """node, shingles: the full sets of the given classes, each made again from the text of one of its documents."""
    one = sketch.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("of_doc"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(one, F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("node", "text")
    return written(found.mapInArrow(_sets_of(k), "node long, shingles binary"), "sets")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components yet: band, node, label, n_shingles, minor (not of the bucket's largest
    component), and in how many blocks the bucket's two kinds of members are dealt (a hash deals them, so no bucket is one task)."""
    weight = F.greatest(8 * F.col("n_shingles"), F.lit(BLOCK_BYTES // BLOCK))
    told = members.filter("n > 2").join(labels, "node", "left").select("band", "node", "n_shingles", F.coalesce("label", "node").alias("label"), weight.alias("weight"))
    parts = told.groupBy("band", "label").agg(F.count("*").alias("c"), F.sum("weight").alias("w"))
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / BLOCK_BYTES)).cast("long")
    whole = parts.groupBy("band").agg(F.max(F.struct("c", "label", "w")).alias("most"), F.sum("w").alias("w"), F.count("*").alias("components")).filter("components > 1")
    whole = whole.select("band", F.col("most.label").alias("major"), blocks(F.col("most.w")).alias("majors"), blocks(F.col("w") - F.col("most.w")).alias("minors"))
    return told.join(whole, "band").select("band", "node", "n_shingles", "label", (F.col("label") != F.col("major")).alias("minor"), "majors", "minors")


#: The tasks that a member takes part in: every block of the others meets every block of its bucket, those of the largest component among themselves excepted.
TASKS = """explode(if(minor,
    concat(transform(sequence(0L, majors - 1), j -> named_struct('i', own, 'j', j, 'kind', 'across', 'side', 0)),
           transform(sequence(0L, minors - 1), j -> named_struct('i', least(own, j), 'j', greatest(own, j), 'kind', 'among', 'side', if(own <= j, 0, 1)))),
    transform(sequence(0L, minors - 1), i -> named_struct('i', i, 'j', own, 'kind', 'across', 'side', 1)))) AS task"""


def labelled(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", held: list | None = None) -> DataFrame:
    """doc_id, n_shingles, node (class of equal sets; null for empty ones), label (component; null for unlinked classes). The
    tables that the result reads are added to `held`, for a caller that is done with it."""
    spark = docs.sparkSession
    full_sketch = written(sketches(docs, k, id_col, text_col), "sketches")
    classes = written(full_sketch.filter("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "classes")
    sketch = written(full_sketch.drop("registers"), "classes-of-documents")
    discard(full_sketch)
    collect_garbage(spark)
    bands = classes.select("node", "registers", "n_shingles").mapInArrow(_band_rows, "band long, node long, n_shingles long")
    buckets = written(bands.groupBy("band").agg(F.min("node").alias("center"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = written(bands.join(buckets, "band"), "members")
    discard(buckets)
    collect_garbage(spark)
    stars = members.filter("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    sized = lambda c, n: classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{n}"), F.col("registers").alias(f"r{n}"))
    likely = stars.join(sized("a", 1), "a").join(sized("b", 2), "b").select("a", "b", "n1", "n2", "r1", "r2").mapInArrow(_hopeful(percent), "a long, b long")
    likely = written(likely, "likely")
    collect_garbage(spark)
    nodes = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    sets = _set_table(nodes, docs, sketch, k, id_col, text_col)
    collect_garbage(spark)
    side = lambda c, name: sets.select(F.col("node").alias(c), F.col("shingles").alias(name))
    links = written(likely.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"), "links")
    discard(likely)
    discard(sets)
    collect_garbage(spark)
    labels = written(connected_components(links), "labels")

    #: Buckets of three and more that the comparisons with their centers did not join.
    apart = written(_apart(members, labels), "apart")
    discard(members)
    if not apart.isEmpty():
        tasks = apart.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors")))).select("band", "node", "label", "n_shingles", F.expr(TASKS)).select("band", "node", "label", "n_shingles", "task.*")
        sets = _set_table(apart.select("node").distinct(), docs, sketch, k, id_col, text_col)
        collect_garbage(spark)
        full = written(sets.dropDuplicates(["node"]).join(classes.select("node", "registers"), "node"), "full")
        discard(sets)
        collect_garbage(spark)
        found = written(tasks.join(full, "node").groupBy("band", "kind", "i", "j").applyInArrow(_across(percent), "a long, b long"), "across")
        discard(full)
        if not found.isEmpty():
            old, labels = labels, written(connected_components(links.unionByName(found)), "labels")
            discard(old)
        discard(found)
    for df in (classes, apart, links):
        discard(df)
    if held is not None:
        held += [sketch, labels]
    collect_garbage(spark)
    return sketch.join(labels, "node", "left")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", held: list | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id)."""
    rows = labelled(docs, k, percent, id_col, text_col, held).withColumn("group", F.coalesce("label", "node"))
    least = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "group", "left").select("doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, that stay: of each component the one with the smallest doc_id. Rows without a doc_id stay; of rows alike in doc_id and text one stays."""
    held: list[DataFrame] = []
    found = written(near_duplicates(docs, k, percent, held=held).select("doc_id", "component_id", "kept"), "kept")
    for df in held:
        discard(df)
    gone = found.filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    if not found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id IS NULL"))
        both = found.filter("kept").select("doc_id").distinct()
        gone = gone.join(both, "doc_id", "left_anti")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


#: Brute force by counts of shared shingles; components by reachability. A word ends at white space; A to Z alone are lowered.
ORACLE = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
  s AS (SELECT DISTINCT i, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS g FROM d),
  n AS (SELECT i, count(*) AS size FROM s GROUP BY i),
  alike AS (SELECT a.i, b.i AS j, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.i < b.i GROUP BY a.i, b.i),
  one AS (SELECT alike.i, alike.j FROM alike JOIN n x ON alike.i = x.i JOIN n y ON alike.j = y.i WHERE 100 * shared >= 80 * (x.size + y.size - shared)),
  links AS (SELECT i, j FROM one UNION ALL SELECT j, i FROM one),
  reach AS (SELECT i, i AS j FROM d UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
  least AS (SELECT r.i, min(d.doc_id) AS component_id FROM reach r JOIN d ON r.j = d.i GROUP BY r.i)
  SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, least.component_id, d.doc_id IS NOT NULL AND d.doc_id = least.component_id AS kept FROM d JOIN least ON d.i = least.i LEFT JOIN n ON d.i = n.i"""


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
