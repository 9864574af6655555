"""Operator 4. Repeated-passage removal with a run-length suffix index.

Every byte that lies in a string of `length` bytes which also starts elsewhere, in any document, goes. Matches never cross
documents; all strings are judged on the input.

Content decides where strings meet: the key of a string is the smallest hash of its GRAM-byte substrings, so equal strings
have equal keys. Strings of a document with one key in a row form a segment. Keys that occur once are done. Segments that are
equal as a whole repeat as a whole. For the other keys, one of each distinct segment is indexed: a run-compressed
Burrows-Wheeler transform with suffix-array samples at run ends and their common-prefix lengths. Inside a run the common
prefix with the neighbouring suffix shrinks by one from position to position, so matching statistics stream over the text from
the samples alone. Chunks hold whole keys and at most CHUNK_BYTES. The segments of a key with more distinct text than
that are cut by how far before the gram of the key their strings start, and keyed anew by all that the strings of such a range
share, in ever smaller ranges (WIDTHS) until they fit: in the last, only equal strings share a key.

A text of n bytes gives about n / 85 segments; of each, two 64-bit hashes and its place are shuffled. Texts travel compressed.

Nulls: null text is an empty one; a null doc_id is kept; rows with one doc_id are documents of their own, and equal rows repeat
each other. Texts shorter than `length` lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_TABLE, discard, mix64, table, written

LENGTH, GRAM = 200, 32
BLOCK_BYTES = 1 << 20
CHUNK_BYTES = 2 << 20
#: Ranges, in bytes, by which the keys that do not fit a chunk are refined, one after the other.
WIDTHS = (32, 6, 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each position, by doubling. One more than the positions may be empty."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, have, part = BYTE_TABLE[data], 1, None
        factor = np.uint64(0x9E3779B97F4A7C15)
        rest = size
        covered = 0
        while rest:
            if rest & 1:
                if part is None:
                    part, covered = power[: len(data) - have + 1], have
                else:
                    m = len(data) - covered - have + 1
                    part = part[:m] * (factor * np.uint64(2 * have + 1)) + power[covered : covered + m]
                    covered += have
            rest >>= 1
            if rest:
                m = len(data) - 2 * have + 1
                power = power[:m] * (factor ^ np.uint64(4 * have)) + power[have : have + m]
                have *= 2
        return mix64(part[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` values in a row."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if width > have else out


#: Low bits that give way to a gram's place: a fixed number, so that equal strings find the same gram in whatever text they stand.
PLACE = np.uint64((1 << 32) - 1)


def least_grams(h: np.ndarray, width: int) -> np.ndarray:
    """Of each `width` grams in a row: the place of the first one with the least hash."""
    return (sliding_least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), width) & PLACE).astype(np.int64)


def segments_of(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of documents laid end to end at bounds: document, first string, number of strings, key, and whether its smallest gram moves in it (only then can strings of one segment be equal)."""
    width = length - GRAM + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    if len(data) < length:
        return none
    h = gram_hashes(data, GRAM)
    least = least_grams(h, width)
    valid = np.zeros(len(least) + 1, np.int32)
    sizes = np.diff(bounds) - length + 1
    has = sizes > 0
    np.add.at(valid, bounds[:-1][has], 1)
    np.add.at(valid, bounds[:-1][has] + sizes[has], -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(at):
        return none
    doc = np.searchsorted(bounds, at, side="right") - 1
    place = least[at]
    key = h[place]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    stop = np.append(first[1:], len(at))
    return doc[first], at[first] - bounds[doc[first]], stop - first, key[first], place[first] != place[stop - 1]


SEGMENTS = "uid long, lo int, n int, key long, seg long, moves boolean"


def _segment_rows(length: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BLOCK_BYTES):
                    size += len(texts[stop])
                    stop += 1
                raw = b"".join(texts[start:stop])
                bounds = np.cumsum([0, *(len(t) for t in texts[start:stop])])
                doc, lo, n, key, moves = segments_of(np.frombuffer(raw, np.uint8), bounds, length)
                begin = (bounds[doc] + lo).tolist()
                seg = np.array([xxhash.xxh3_64_intdigest(raw[b:e]) for b, e in zip(begin, (bounds[doc] + lo + n + length - 1).tolist(), strict=True)], np.uint64)
                arrays = pa.array(uids[start:stop][doc]), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(moves)
                yield pa.RecordBatch.from_arrays(list(arrays), names=["uid", "lo", "n", "key", "seg", "moves"])
                start = stop

    return run


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array by prefix doubling from 8 bytes; and the ranks at each length, for common prefixes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    # of equal keys the later, shorter suffix comes first; the last 8 are ranked apart, for a zero after the end is not one inside
    order = n - 1 - np.argsort(key[::-1], kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    ends = order >= n - 8
    new |= ends
    new[1:] |= ends[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    levels = [(8, rank)]
    have = 8
    while rank.max(initial=0) < n - 1:
        second = np.zeros(n, np.int64)
        second[: max(0, n - have)] = rank[have:] + 1
        both = rank * (n + 1) + second
        order = np.argsort(both)
        sorted_both = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_both[1:] != sorted_both[:-1]]))
        have *= 2
        levels.append((have, rank))
    return order, levels


def common_prefix(text: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        while True:
            x, y = a + out, b + out
            fits = (x < n) & (y < n)
            same = np.zeros(len(a), bool)
            same[fits] = rank[x[fits]] == rank[y[fits]]
            if not same.any():
                break
            out[same] += size
            if size < levels[-1][0]:
                break
    for _ in range(8):
        x, y = a + out, b + out
        fits = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[fits] = text[x[fits]] == text[y[fits]]
        if not same.any():
            break
        out[same] += 1
    return out


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform with suffix samples at both ends of each run, each with the bytes that it shares with the suffix across the run's border."""

    def __init__(self, text: np.ndarray):
        self.size = len(text)
        order, levels = suffix_array(text)
        before = np.where(order == 0, 256, text[order - 1].astype(np.int16))  # nothing stands before the text
        border = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.run_bytes = before[np.append(0, border)]
        self.run_starts = np.append(0, border)
        shared = common_prefix(text, levels, order[border - 1], order[border])
        self.heads, self.tails = order[border], order[border - 1]
        # the first row has no suffix above it, the last none below
        self.up = self._by_place(np.append(self.heads, order[0]), np.append(shared, 0))
        self.down = self._by_place(np.append(self.tails, order[-1]), np.append(shared, 0))

    @staticmethod
    def _by_place(place: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sort = np.argsort(place)
        return place[sort], shared[sort]

    def _stream(self, samples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        place, shared = samples
        at = np.arange(self.size)
        last = np.searchsorted(place, at, side="right") - 1
        out = shared[np.maximum(last, 0)] - (at - place[np.maximum(last, 0)])
        return np.where(last >= 0, np.maximum(out, 0), 0)

    def matching_statistics(self) -> np.ndarray:
        """The longest string from each position that also starts at another one."""
        return np.maximum(self._stream(self.up), self._stream(self.down))


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each part: which of its strings of `length` bytes start elsewhere too, in these parts."""
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    long = RunLengthIndex(text).matching_statistics() >= length
    out, at = [], 0
    for p in parts:
        out.append(long[at : at + max(0, len(p) - length + 1)])
        at += len(p) + 1
    return out


def ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


FOUND = "key long, seg long, hits array<struct<lo:int,n:int>>"
HITS = pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int32())]))


def _indexed(length: int):
    """Rows (key, seg, bytes) in order of key -> the repeated strings of each segment, by chunks of whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        size, border = 0, 0

        def done(part: list) -> pa.RecordBatch:
            hits = [[{"lo": a, "n": b - a} for a, b in ranges(m)] for m in repeated_starts([r[2] for r in part], length)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array(hits, HITS)], names=["key", "seg", "hits"])

        for batch in batches:
            for key, seg, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if rows and key != rows[-1][0]:
                    border = len(rows)
                rows.append((key, seg, raw))
                size += len(raw) + 1
                if size > CHUNK_BYTES and border:
                    yield done(rows[:border])
                    rows, border = rows[border:], 0
                    size = sum(len(r[2]) + 1 for r in rows)
        if rows:
            yield done(rows)

    return run


SUB = "key long, seg long, lo int, n int, sub_key long, sub_seg long, raw binary"


def refined(raw: bytes, length: int, width: int) -> list[tuple[int, int, int, int]]:
    """A segment cut where its least gram moves, and by how far before that gram strings start, in ranges of `width` bytes: first
    string, number of strings, key, hash of the bytes. The key is a hash of what all strings of that range around that gram
    share, so equal strings keep equal keys; with a width of 1 it is a hash of the string."""
    import xxhash

    place = least_grams(gram_hashes(np.frombuffer(raw, np.uint8), GRAM), length - GRAM + 1)
    at = np.arange(len(place))
    part = (place - at) // width
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])]))
    out = []
    for i, j, p, r in zip(first.tolist(), [*first[1:].tolist(), len(place)], place[first].tolist(), part[first].tolist(), strict=True):
        near, far = r * width, min((r + 1) * width, length - GRAM + 1) - 1
        core = raw[p - near : p - far + length]
        out.append((i, j - i, xxhash.xxh3_64_intdigest(core, seed=r + 1), xxhash.xxh3_64_intdigest(raw[i : j + length - 1])))
    return out


def _refined(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, seg, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = refined(raw, length, width)
                for at in range(0, len(rows), 5000):
                    own = rows[at : at + 5000]
                    lo, n, keys, segs = zip(*own, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * len(own), pa.int64()),
                            pa.array([seg] * len(own), pa.int64()),
                            pa.array(lo, pa.int32()),
                            pa.array(n, pa.int32()),
                            pa.array(np.array(keys, np.uint64).view(np.int64)),
                            pa.array(np.array(segs, np.uint64).view(np.int64)),
                            pa.array([raw[i : i + m + length - 1] for i, m in zip(lo, n, strict=True)], pa.binary()),
                        ],
                        names=[c.split()[0] for c in SUB.split(", ")],
                    )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([z.compress((t.as_py() or "").encode()) for t in part.column(2)], pa.binary())], names=["uid", "doc_id", "packed"])


def _pieces(length: int):
    """A document's bytes and the segments wanted of it -> a row for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for packed, wanted in zip(batch.column(0).slice(at, 200).to_pylist(), batch.column(1).slice(at, 200).to_pylist(), strict=True):
                    raw = z.decompress(packed)
                    rows += [(w["key"], w["seg"], raw[w["lo"] : w["lo"] + w["n"] + length - 1]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["key", "seg", "raw"])

    return run


def _cut(length: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, removed, spans, kept = [], [], [], []
                for packed, hits in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = z.decompress(packed)
                    gone = np.zeros(len(raw) + 1, np.int32)
                    for h in hits or ():
                        gone[h["lo"]] += 1
                        gone[min(len(raw), h["lo"] + h["n"] + length - 1)] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    cut = ranges(gone)
                    rest = np.frombuffer(raw, np.uint8)[~gone].tobytes() if cut else raw
                    sizes.append(len(raw))
                    removed.append(len(raw) - len(rest))
                    spans.append(len(cut) if digest else [{"start": a, "stop": b} for a, b in cut])
                    kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
                kinds = (pa.int64(), pa.string()) if digest else (pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kinds[0]), pa.array(kept, kinds[1])], names=names)

    return run



def _whole():
    """One run of all strings of a segment."""
    return F.array(F.struct(F.lit(0).alias("lo"), F.col("n")))


def _repeats(pieces: DataFrame, length: int, chunk_bytes: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Of distinct segments (key, seg, raw): the runs of repeated strings in those that have some. Keys with more text than a
    chunk holds are refined until they fit; with the last width, equal strings alone share a key."""
    index = lambda df: df.select("key", "seg", "raw").repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_indexed(length), FOUND).filter("size(hits) > 0")
    if not widths:
        return index(pieces)
    huge = written(pieces.groupBy("key").agg(F.sum(F.length("raw")).alias("bytes")).filter(F.col("bytes") > chunk_bytes).select("key"), "huge")
    if huge.isEmpty():
        return index(pieces)
    sub = written(pieces.join(huge, "key", "left_semi").mapInArrow(_refined(length, widths[0]), SUB), "refined")
    again = sub.groupBy("sub_key").agg(F.count("*").alias("rows")).filter("rows > 1").select("sub_key")
    kinds = written(sub.join(again, "sub_key", "left_semi").groupBy("sub_key", "sub_seg").agg(F.count("*").alias("times"), F.first("raw").alias("raw")), "kinds")
    inner = written(_repeats(kinds.select(F.col("sub_key").alias("key"), F.col("sub_seg").alias("seg"), "raw"), length, chunk_bytes, widths[1:]), "hits")
    found = inner.select(F.col("key").alias("sub_key"), F.col("seg").alias("sub_seg"), "hits")
    told = sub.select("key", "seg", "lo", "n", "sub_key", "sub_seg").join(kinds.select("sub_key", "sub_seg", "times"), ["sub_key", "sub_seg"]).join(found, ["sub_key", "sub_seg"], "left")
    runs = told.select("key", "seg", "lo", F.when(F.col("times") > 1, _whole()).otherwise(F.col("hits")).alias("hits")).filter("hits IS NOT NULL")
    moved = F.transform("hits", lambda h: F.struct((h["lo"] + F.col("lo")).alias("lo"), h["n"].alias("n")))
    large = written(runs.groupBy("key", "seg").agg(F.flatten(F.collect_list(moved)).alias("hits")), "large")
    for df in (sub, kinds, inner):
        discard(df)
    return index(pieces.join(huge, "key", "left_anti")).unionByName(large)


def _hits(packed: DataFrame, texts: DataFrame, length: int, chunk_bytes: int) -> DataFrame:
    """uid, hits: the places of repeated strings in each document that has some."""
    found = written(texts.mapInArrow(_segment_rows(length), SEGMENTS), "segments")
    groups = found.groupBy("key").agg(F.count("*").alias("times"), F.min("seg").alias("low"), F.max("seg").alias("high"), F.max("moves").alias("any")).filter("times > 1 OR any")
    groups = groups.select("key", F.expr("low <> high OR any").alias("mixed"))
    again = written(found.join(groups, "key"), "repeats")
    discard(found)
    alike = again.filter("NOT mixed").select("uid", "lo", "n")
    mixed = again.filter("mixed")
    kinds = written(mixed.groupBy("key", "seg").agg(F.count("*").alias("times"), F.min(F.struct("uid", "lo", "n")).alias("one")), "kinds")
    wanted = kinds.select("one.uid", F.struct("key", "seg", "one.lo", "one.n").alias("w")).groupBy("uid").agg(F.collect_list("w").alias("wanted"))
    pieces = written(packed.dropDuplicates(["uid"]).join(wanted, "uid").select("packed", "wanted").mapInArrow(_pieces(length), "key long, seg long, raw binary"), "pieces")
    hits = written(_repeats(pieces, length, chunk_bytes), "hits")
    discard(pieces)
    times = kinds.select("key", "seg", "times")
    told = mixed.join(times, ["key", "seg"]).join(hits, ["key", "seg"], "left").select("uid", "lo", F.explode(F.when(F.col("times") > 1, _whole()).otherwise(F.col("hits"))).alias("h")).select("uid", (F.col("lo") + F.col("h.lo")).alias("lo"), "h.n")
    out = written(alike.unionByName(told).groupBy("uid").agg(F.collect_set(F.struct("lo", "n")).alias("hits")), "places")
    for df in (again, kinds, hits):
        discard(df)
    return out


def _removed(docs: DataFrame, length: int, digest: bool, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    packed = rows.select("uid", "doc_id", "text").mapInArrow(_packed, "uid long, doc_id long, packed binary")
    hits = _hits(packed.select("uid", "packed"), rows.select("uid", "text"), length, chunk_bytes)
    schema = "doc_id long, n_bytes long, n_removed long, " + ("n_spans long, kept_sha256 string" if digest else "spans array<struct<start:long,stop:long>>, kept binary")
    return packed.join(hits, "uid", "left").select("doc_id", "packed", "hits").mapInArrow(_cut(length, digest), schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte ranges removed), kept (the remaining bytes)."""
    return _removed(docs, length, False)


#: Brute force over all strings of 200 bytes, two hexadecimal digits a byte.
ORACLE = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  starts AS MATERIALIZED (SELECT i, p, md5_number(substr(h, 2 * p + 1, 400)) AS g FROM (SELECT i, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS p FROM d) x),
  again AS (SELECT i, p FROM starts WHERE g IN (SELECT g FROM starts GROUP BY g HAVING count(*) > 1)),
  marks AS (SELECT i, p, CASE WHEN p - lag(p) OVER w <= 200 THEN 0 ELSE 1 END AS fresh FROM again WINDOW w AS (PARTITION BY i ORDER BY p)),
  runs AS (SELECT i, min(p) AS a, max(p) + 200 AS b FROM (SELECT i, p, sum(fresh) OVER (PARTITION BY i ORDER BY p ROWS UNBOUNDED PRECEDING) AS r FROM marks) y GROUP BY i, r),
  cuts AS (SELECT i, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM runs GROUP BY i)
  SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(CASE WHEN n_spans IS NULL THEN unhex(h) ELSE unhex(array_to_string(list_transform(range(0, n_spans + 1), lambda k: substr(h, CASE WHEN k = 0 THEN 1 ELSE 2 * ends[k] + 1 END, CASE WHEN k = n_spans THEN length(h) ELSE 2 * starts[k + 1] - CASE WHEN k = 0 THEN 0 ELSE 2 * ends[k] END END)), '')) END) AS kept_sha256
  FROM d LEFT JOIN cuts ON d.i = cuts.i"""


def op4_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(table(spark, sf_dir, "documents"), LENGTH, True)
