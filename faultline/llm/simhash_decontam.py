"""Operator 7. Benchmark decontamination by SimHash of item-sized windows.

An item is the bag of its SHINGLE-word shingles (all its words as one, if it has fewer), lower-cased as A-Z and cut at white
space. A document is read in windows of the item's own length in words. The second and each further occurrence of a shingle in
a bag count as shingles of their own, so a bag is a set and every element of it weighs the same. A fingerprint has BITS bits:
the signs of the summed element hashes. BLOCKS blocks of a fingerprint key an index of items; a window looks up every block
value within the block's share of the radius, so each item within RADIUS bits is found for certain. Found items are verified by
weighted similarity, the sum of smaller over the sum of larger shingle counts, of at least `percent`.

Of windows that start at every word, those are fingerprinted that can reach the threshold with any item of that length: at
least so many of their shingles must be shingles of such items, whatever their order. That count slides over the document and
loses no window. Items of at most FEW elements are not left to a fingerprint, whose bits would hang on too few signs: they are
found by any shared shingle and verified. Above that, two sets of similarity 0.8 differ in 78 of 512 bits on average, whatever
words they repeat; RADIUS lies six standard deviations above. The chance to miss a window is below 1e-6 for sets of any sizes.

Items are sent to all executors while they take at most MAX_ITEM_BYTES; beyond that they are dealt with in as many parts, each
in a pass of its own over the documents.

Nulls and empty texts, of documents or items, match nothing. Equal items all report. Rows with one doc_id are one document
for its result. Empty tables give no matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, shingle_hashes, table, word_hashes, word_spans

SHINGLE = 5
BITS, BLOCKS = 512, 64
RADIUS = 127
MAX_ITEM_BYTES = 8_000_000
#: Elements of the bags that are verified without a fingerprint.
FEW = 24
#: Words of a document whose windows are fingerprinted at once.
STRETCH = 4096
_SALTS = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingled(text: str | None) -> tuple[np.ndarray, int]:
    """Shingle hashes in order, and the number of words."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    words = word_hashes(data, *word_spans(data))
    return shingle_hashes(words, min(SHINGLE, len(words)) or 1), len(words)


def bit_signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash, (hashes, BITS)."""
    wide = mix64(hashes[:, None] ^ _SALTS)
    bits = np.unpackbits(wide.view(np.uint8).reshape(len(hashes), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def elements(hashes: np.ndarray) -> np.ndarray:
    """The bag as a set: the hash of a shingle for its first occurrence, and another one for each further."""
    x, n = np.unique(hashes, return_counts=True)
    if len(x) == len(hashes):
        return hashes
    which = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
    x = np.repeat(x, n)
    with np.errstate(over="ignore"):
        return np.where(which > 0, mix64(x + which.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), x)


def fingerprints(signs: np.ndarray) -> np.ndarray:
    """Packed fingerprints of rows of summed signs; a sum of 0 counts as set."""
    return np.packbits(signs >= 0, axis=-1)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sum of smaller and sum of larger counts of two bags of shingles."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low, len(a) + len(b) - low


class ItemIndex:
    """Items by the values of their fingerprint blocks, and the lengths of the items that have a shingle."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids, self.bags, self.words = [], [], []
        for item_id, text in items:
            bag, n = shingled(text)
            if n:
                self.ids.append(item_id)
                self.bags.append(bag)
                self.words.append(n)
        self.prints = np.array([fingerprints(bit_signs(elements(b)).sum(0, dtype=np.int32)) for b in self.bags], np.uint8).reshape(-1, BITS // 8)
        size = BITS // BLOCKS
        spare = RADIUS // BLOCKS
        near = [sum(1 << i for i in flips) for k in range(spare + 1) for flips in combinations(range(size), k)]
        self.blocks: list[dict[int, set[int]]] = [defaultdict(set) for _ in range(BLOCKS)]
        for i, p in enumerate(self.prints):
            if len(self.bags[i]) > FEW:
                for block, value in zip(self.blocks, p.tolist(), strict=True):
                    for flip in near:
                        block[value ^ flip].add(i)
        self.shingles_of = [min(SHINGLE, n) for n in self.words]
        self.lengths: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.short: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, (bag, n, k) in enumerate(zip(self.bags, self.words, self.shingles_of, strict=True)):
            for h in set(bag.tolist()):
                self.lengths[k, h].add(n)
                if len(bag) <= FEW:
                    self.short[n, h].add(i)
        self.known = {k: np.array(sorted({h for bag, n in zip(self.bags, self.shingles_of, strict=True) if n == k for h in bag.tolist()}), np.uint64) for k in sorted(set(self.shingles_of))}

    def found(self, prints: np.ndarray) -> list[np.ndarray]:
        """Of each fingerprint: the items within RADIUS bits. Block values that differ by at most RADIUS // BLOCKS bits meet in the index."""
        out = []
        for p in prints:
            near = set().union(*[block.get(v, ()) for block, v in zip(self.blocks, p.tolist(), strict=True)])
            near = np.fromiter(near, np.int64, len(near))
            apart = np.bitwise_count(self.prints[near] ^ p).sum(1) if len(near) else near
            out.append(near[apart <= RADIUS])
        return out

    def _near(self, h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """The items whose fingerprints are near those of the windows. Signs slide over a stretch; a window that repeats a shingle is summed by itself, equal ones once."""
        order = np.argsort(h, kind="stable")
        before = np.full(len(h), -1)
        same = h[order[1:]] == h[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        known: dict[bytes, np.ndarray] = {}
        for b in np.split(np.arange(len(begins)), np.flatnonzero(np.diff(begins // STRETCH)) + 1):
            s, e = begins[b], ends[b]
            low = int(s[0])
            sums = np.zeros((int(e.max()) - low + 1, BITS), np.int32)
            np.cumsum(bit_signs(h[low : int(e.max())]), axis=0, dtype=np.int32, out=sums[1:])
            prints = fingerprints(sums[e - low] - sums[s - low])
            for x, y, p in zip(s.tolist(), e.tolist(), prints, strict=True):
                if (before[x:y] >= x).any():
                    own = np.sort(h[x:y])
                    p = known.get(own.tobytes())
                    if p is None:
                        p = known[own.tobytes()] = fingerprints(bit_signs(elements(own)).sum(0, dtype=np.int32))
                        if len(known) > STRETCH:
                            known = {}
                yield x, y, self.found(p[None])[0]

    def matches(self, text: str | None, percent: int) -> list[tuple[int, int, int, int, int]]:
        """(item_id, start, stop, low, high): the best window in bytes for each matching item, with its similarity as low / high; the first of equals."""
        data = np.frombuffer((text or "").encode(), np.uint8)
        starts, ends = word_spans(data)
        words = word_hashes(data, starts, ends)
        windows: dict[tuple[int, int], np.ndarray] = {}
        bags: dict[int, np.ndarray] = {}
        for k, known in self.known.items():
            h = bags[k] = shingle_hashes(words, k)
            at = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h)
            shared = defaultdict(list)
            for p in hit.tolist():
                for n in self.lengths[k, int(h[p])]:
                    shared[n].append(p)
            for n, places in shared.items():
                size, window = n - k + 1, min(n - k + 1, len(h))
                least = -(-percent * (size + window) // (100 + percent))
                if len(places) >= least:
                    below = np.zeros(len(h) + 1, np.int64)
                    below[np.array(places) + 1] = 1
                    below = np.cumsum(below)
                    begins = np.flatnonzero(below[window:] - below[: len(below) - window] >= least)
                    if len(begins):
                        windows[k, n] = begins
        best: dict[int, tuple] = {}
        for (k, n), begins in windows.items():
            h = bags[k]
            size = n - k + 1
            ends_at = np.minimum(begins + size, len(h))
            if size <= FEW:
                found = ((x, y, set().union(*(self.short.get((n, v), ()) for v in set(h[x:y].tolist())))) for x, y in zip(begins.tolist(), ends_at.tolist(), strict=True))
            else:
                found = ((x, y, [i for i in near.tolist() if self.words[i] == n]) for x, y, near in self._near(h, begins, ends_at))
            for x, y, near in found:
                for i in near:
                    less, more = weighted_similarity(h[x:y], self.bags[i])
                    if 100 * less >= percent * more and (i not in best or less * best[i][3] > best[i][2] * more):
                        best[i] = (x, min(x + n, len(words)), less, more)
        return [(self.ids[i], int(starts[x]), int(ends[y - 1]), less, more) for i, (x, y, less, more) in sorted(best.items())]


MATCHES = "doc_id long, item_id long, start long, stop long, similarity double"


def matched(docs: DataFrame, items: list[tuple[int, str | None]], percent: int = 80) -> DataFrame:
    """Matches of documents with the given items, bounded in number. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    index: list[ItemIndex] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not index:
            index.append(ItemIndex(shared.value))
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in index[0].matches(t.as_py(), percent)]
            columns = [[r[i] for r in rows] for i in range(4)] + [[r[4] / r[5] for r in rows]]
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in MATCHES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MATCHES)


def item_parts(items: DataFrame, most: int = MAX_ITEM_BYTES) -> list[list[tuple[int, str | None]]]:
    """The items in parts of at most `most` bytes each (one item at least)."""
    parts: list[list] = [[]]
    size = 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        n = len((r.text or "").encode())
        if parts[-1] and size + n > most:
            parts.append([])
            size = 0
        parts[-1].append((r.item_id, r.text))
        size += n
    return parts


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, item_id, start, stop (bytes of the best window), similarity: one row for each document and item that match."""
    out = None
    for part in item_parts(items):
        found = matched(docs, part, percent)
        out = found if out is None else out.unionByName(found)
    return out


def op7_simhash_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The documents, all columns, that match no item. A pass for each part of the items; no shuffle."""
    at_text = docs.columns.index("text")
    for part in item_parts(items):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        index: list[ItemIndex] = []

        def run(batches: Iterator[pa.RecordBatch], shared=shared, index=index) -> Iterator[pa.RecordBatch]:
            if not index:
                index.append(ItemIndex(shared.value))
            for batch in batches:
                yield batch.filter(pa.array([not index[0].matches(t.as_py(), percent) for t in batch.column(at_text)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
