"""Operator 1. Token-id files: id blocks whose document boundaries are Elias-Fano coded.

A store is a Parquet folder. A row is a block: consecutive documents in ascending doc_id order, their ids concatenated as
little-endian integers of the narrowest of 2 or 4 bytes that holds the vocabulary, and the documents' end positions as an
Elias-Fano sequence with select samples. Blocks of a range partition carry the ids before them in that partition; what lies
in earlier partitions is one prefix sum over a row per partition, so no step orders all documents in one task.

Nulls: null text is an empty document (it still gets the end id); a null doc_id is kept and sorts first; repeated doc_ids
stay separate documents, ordered by text. An empty table gives an empty store.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_folder, table

BLOCK_TOKENS = 1 << 19
SELECT_EVERY = 256
_HEAD = struct.Struct("<4sIQBI")


def _select_word(bits: np.ndarray, start: int, k: int) -> int:
    """Position of the k-th (from 0) set bit of packed bits at or after bit position start."""
    byte, skip = divmod(start, 8)
    while True:
        ones = np.flatnonzero(np.unpackbits(bits[byte : byte + 64], bitorder="little")[skip:])
        if k < len(ones):
            return byte * 8 + skip + int(ones[k])
        k -= len(ones)
        byte, skip = byte + 64, 0


class EliasFano:
    """A non-decreasing sequence below 2**63 in about 2 + log2(u/n) bits an entry; select(i) reads a bounded stretch of it."""

    def __init__(self, data: bytes):
        magic, self.n, self.universe, self.low_bits, samples = _HEAD.unpack_from(data)
        if magic != b"EF01":
            raise ValueError("not an Elias-Fano sequence")
        at = _HEAD.size
        self.samples = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        low = (self.n * self.low_bits + 7) // 8
        self.low = np.frombuffer(data, np.uint8, low, at)
        self.high = np.frombuffer(data, np.uint8, offset=at + low)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        high = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        bits[high] = 1
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
        samples = high[::SELECT_EVERY].astype("<u4")
        return _HEAD.pack(b"EF01", n, universe, low_bits, len(samples)) + samples.tobytes() + np.packbits(low, bitorder="little").tobytes() + np.packbits(bits, bitorder="little").tobytes()

    def _low(self, i: int) -> int:
        value = 0
        for j in range(self.low_bits):
            at = i * self.low_bits + j
            value |= (int(self.low[at >> 3]) >> (at & 7) & 1) << j
        return value

    def select(self, i: int) -> int:
        """Entry i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = _select_word(self.high, int(self.samples[i // SELECT_EVERY]), i % SELECT_EVERY)
        return (at - i) << self.low_bits | self._low(i)

    def select_range(self, start: int, stop: int) -> np.ndarray:
        """Entries start to stop, from the stretches between the samples around them; nothing before is read."""
        parts = [np.zeros(0, np.int64)]
        for b in range(start // SELECT_EVERY, -(-stop // SELECT_EVERY)) if stop > start else ():
            first = int(self.samples[b])
            last = int(self.samples[b + 1]) if b + 1 < len(self.samples) else 8 * len(self.high)
            at = np.flatnonzero(np.unpackbits(self.high[first >> 3 : (last + 7) >> 3], bitorder="little")) + (first >> 3 << 3)
            at = at[(at >= first) & (at < last)][: self.n - b * SELECT_EVERY]
            i = np.arange(b * SELECT_EVERY, b * SELECT_EVERY + len(at))
            low = np.zeros(len(at), np.int64)
            if self.low_bits:
                bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
                low = (self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
            value = (at - i).astype(np.int64) << self.low_bits | low
            parts.append(value[max(0, start - i[0]) : stop - i[0]])
        return np.concatenate(parts)

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        low = np.zeros(self.n, np.int64)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            low = bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (high.astype(np.int64) << self.low_bits) | low


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class CachedTokenizer:
    """The tokenizers library over distinct pieces of text.

    Its word tokenizer drops white space and cuts at every change between letters, digits and the rest, so the ids of a text
    are those of its space-separated pieces in a row; a piece is encoded once while the cache holds it. Pieces that need no
    Unicode normalisation and lower-case letter by letter go straight to the library's BPE model; all others, and texts with
    special tokens, go through its whole pipeline. Other tokenizers are used as they are.
    """

    SIMPLE = re.compile("[\x21-\x7e\xa1-įı-ſ]+")
    CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|[0-9]|(?:[^\\w]|_)+")
    #: Below U+0180, what \w holds besides letters: superscripts and fractions, which the vocabulary's pattern takes as numbers.
    ODD = re.compile("[\xaa\xb2\xb3\xb9\xba\xbc-\xbe]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_padding()
        self.full.no_truncation()
        spec = json.loads(self.full.to_str())
        self.width = 2 if self.full.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = "<u2" if self.width == 2 else "<u4"
        self.code = "H" if self.width == 2 else "I"
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_piece = spec["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in json.dumps(spec["normalizer"]) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.model = self.full.model
        self.model._resize_cache(0)
        self.alphabet = byte_alphabet()
        self.pieces = _Memo(self._piece, 300_000)
        self.words = _Memo(self._word, 500_000)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes() if sys.byteorder == "big" else array(self.code, ids).tobytes()

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join([self.alphabet[b] for b in word.encode()])
        return self._pack([t.id for t in self.model.tokenize(mapped)])

    def _piece(self, piece: str) -> bytes:
        tail = b""
        if piece[-1:] in (".", ","):
            core = piece[:-1]
            if core.isalpha() and (core.isascii() or self.SIMPLE.fullmatch(core)):
                piece, tail = core, self.words[piece[-1]]
        if piece.isascii() and piece.isalpha():
            return self.words[piece.lower()] + tail
        if self.SIMPLE.fullmatch(piece) and not self.ODD.search(piece) and unicodedata.is_normalized("NFC", piece):
            return b"".join([self.words[w] for w in self.CUT.findall(piece.lower())]) + tail
        return self._pack(self.full.encode(piece, add_special_tokens=False).ids) + tail if piece else b""

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed in self.dtype."""
        if not self.by_piece or any(s in text for s in self.special):
            return self._pack(self.full.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


class _Memo(dict):
    """Results by key, made on demand; emptied when it is full."""

    def __init__(self, make, capacity: int):
        super().__init__()
        self.make, self.capacity = make, capacity

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.capacity:
            self.clear()
        self[key] = value
        return value


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def _tokenizer(path: str) -> CachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


BLOCKS = "part int, block int, part_start long, n_docs long, n_tokens long, id_bytes int, doc_ids array<long>, ids binary, bounds binary"


def _encode_blocks(tokenizer_path: str, end_id: int | None, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = _tokenizer(tokenizer_path)
        tail = b"" if end_id is None else np.array([end_id], tok.dtype).tobytes()
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, ends, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            row = [part], [block], [before], [len(ends)], [size // tok.width], [tok.width], [doc_ids], [b"".join(ids)], [EliasFano.encode(np.array(ends))]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = tok.encode(text.as_py() or "") + tail
                ids.append(got)
                size += len(got)
                doc_ids.append(doc_id)
                ends.append(size // tok.width)
                if size >= block_tokens * tok.width:
                    yield close()
                    before += size // tok.width
                    block, ids, doc_ids, ends, size = block + 1, [], [], [], 0
        if ends:
            yield close()

    return run


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the store. The one shuffle range-partitions the documents by id."""
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode_blocks(tokenizer_path, end_id, block_tokens), BLOCKS).write.parquet(path)


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with start, the ids before each in the whole store. Its sum runs over a row per range partition."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return blocks.join(before, "part").withColumn("start", F.col("before") + F.col("part_start"))


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], "<u2" if row["id_bytes"] == 2 else "<u4").astype("<u4")
            bounds = EliasFano(row["bounds"])
            ends = bounds.select_range(0, bounds.n)
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: start, length and crc32 of its ids."""
    return read_token_store(spark, path).select("ids", "bounds", "doc_ids", "id_bytes", "start").mapInArrow(_digests, DIGEST)


def op1_token_store(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    path = new_folder(spark, "token-store")
    write_token_store(table(spark, sf_dir, "documents"), path, tokenizer_path)
    return digests(spark, path)
