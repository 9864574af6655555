"""Operator 3. Byte-level BPE by an index from each pair to all its positions.

The distinct pre-tokens of a block of texts lie in one symbol array. The index maps the rank of each mergeable pair to the
positions where it occurs. Ranks with occurrences are taken in ascending order; all valid occurrences merge at once, and the
pairs that arise to their left and right go into the lists of their own ranks. In a trained vocabulary a merge that uses a
symbol ranks after the one that makes it (checked when the vocabulary is loaded), so one ascending pass is exact.

Nulls: null text is an empty text; null and repeated doc_ids are kept as they are. Empty texts have no ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts go through the index together until they hold so many characters.
BLOCK_CHARS = 2_000_000


class PairIndexBPE:
    def __init__(self, path: str):
        import regex

        from .token_store import byte_alphabet

        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(self.byte_of[c] for c in token) if all(c in self.byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], strict=True))
        self.left, self.right, self.made = left.astype(np.int32), right.astype(np.int32), made.astype(np.int32)
        self.size = len(self.token_bytes)
        first = np.full(self.size, -1)
        first[made[::-1]] = np.arange(len(made))[::-1]
        if (first[left] >= np.arange(len(made))).any() or (first[right] >= np.arange(len(made))).any():
            raise ValueError("a merge uses a symbol that a later merge makes: ranks cannot be taken in ascending order")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order
        self.split = regex.compile(PATTERN)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, np.ndarray] = {}
        self.pieces: dict[str, tuple[bytes, bytes]] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], -1)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each pre-token."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw])
        ends = np.cumsum(sizes)
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends - sizes] = -1
        at = np.flatnonzero(nxt >= 0)
        ranks = self.ranks(sym[at], sym[at + 1])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, at: np.ndarray) -> None:
            keep = ranks >= 0
            ranks, at = ranks[keep], at[keep]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(ranks, kind="stable")
                ranks, at = ranks[order], at[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                r = int(ranks[i])
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(active, r)

        add(ranks, at)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b, c = self.left[r], self.right[r], self.made[r]
            p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            p = p[sym[p] == a]
            q = nxt[p]
            fits = q >= 0
            p, q = p[fits], q[fits]
            fits = sym[q] == b
            p, q = p[fits], q[fits]
            if not len(p):
                continue
            if a == b and len(p) > 1:  # runs of one symbol merge from the left, without overlap
                chain = np.concatenate([[False], p[1:] == q[:-1]])
                start = np.maximum.accumulate(np.where(chain, 0, np.arange(len(p))))
                fits = (np.arange(len(p)) - start) % 2 == 0
                p, q = p[fits], q[fits]
            after = nxt[q]
            sym[p] = c
            sym[q] = -1
            nxt[p] = after
            has = after >= 0
            prv[after[has]] = p[has]
            before = prv[p]
            had = before >= 0
            at = np.concatenate([before[had], p[has]])
            if len(at):
                add(self.ranks(sym[at], sym[nxt[at]]), at)
        alive = sym >= 0
        ids = sym[alive]
        stops = np.cumsum(alive)[ends - 1]
        return np.split(ids, stops[:-1])

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that pre-tokenise on their own: where white space is single blanks, each blank starts one."""
        if not text:
            return []
        if self._joined(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    @staticmethod
    def _joined(text: str) -> bool:
        if text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text:
            return True
        return not text.isascii() and any(x in text for x in WIDE_SPACES) or any(x in text for x in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")

    def sections(self, text: str) -> list[str]:
        """Text between special tokens, and the tokens themselves."""
        if self.special_split is None or not any(s in text for s in self.special):
            return [text]
        return self.special_split.split(text)

    CAPACITY = 120_000

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; afterwards self.pieces holds the ids and the decoded bytes of each of them."""
        if len(self.pieces) > self.CAPACITY:
            self.pieces.clear()
        if len(self.words) > self.CAPACITY:
            self.words.clear()
        parts = [[c for s in self.sections(t) for c in ([s] if s in self.special else self.chunks(s))] for t in texts]
        new = set()
        for p in parts:
            new.update(p)
        new = [x for x in new if x not in self.pieces]
        cut = [[x] if x in self.special else self.split.findall(x) for x in new]
        fresh = list(dict.fromkeys(w for ws in cut for w in ws if w not in self.words and w not in self.special))
        self.words.update(zip(fresh, self.encode_words(fresh), strict=True))
        table = self.token_bytes
        for x, ws in zip(new, cut, strict=True):
            if x in self.special:
                ids = np.array([self.special[x]], np.int32)
            else:
                ids = self.words[ws[0]] if len(ws) == 1 else np.concatenate([self.words[w] for w in ws])
            self.pieces[x] = ids.astype("<u4").tobytes(), b"".join([table[i] for i in ids.tolist()])
        return parts

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text: its ids as little-endian 32-bit integers, and the bytes that they decode to."""
        out = []
        for parts in self.learn(texts):
            got = [self.pieces[p] for p in parts]
            out.append((b"".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        return out

    def decode(self, ids) -> str:
        return b"".join([self.token_bytes[i] for i in ids]).decode("utf-8", "replace")


#: White space beyond ASCII.
WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_MODELS: dict[str, PairIndexBPE] = {}


def model(path: str) -> PairIndexBPE:
    if path not in _MODELS:
        _MODELS[path] = PairIndexBPE(path)
    return _MODELS[path]


def blocks_of(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


COLUMNS = {"ids": ("ids binary", pa.binary()), "decoded": ("decoded string", pa.string()), "n_tokens": ("n_tokens long", pa.int64()), "ids_sha256": ("ids_sha256 string", pa.string()), "decoded_sha256": ("decoded_sha256 string", pa.string())}


def _column(name: str, ids: bytes, decoded: bytes):
    if name == "ids":
        return ids
    if name == "n_tokens":
        return len(ids) // 4
    if name == "ids_sha256":
        return hashlib.sha256(ids).hexdigest()
    text = decoded.decode("utf-8", "replace")
    return text if name == "decoded" else hashlib.sha256(text.encode()).hexdigest()


def _mapped(docs: DataFrame, path: str, names: list[str], id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for block in blocks_of(texts):
                got = bpe.encode_batch(texts[block])
                columns = [pa.array([_column(n, *g) for g in got], COLUMNS[n][1]) for n in names]
                yield pa.RecordBatch.from_arrays([batch.column(0)[block.start : block.stop], *columns], names=["doc_id", *names])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, ", ".join(["doc_id long", *[COLUMNS[n][0] for n in names]]))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 32-bit) and the text that they decode to. No shuffle."""
    return _mapped(docs, tokenizer_path, ["ids", "decoded"], id_col, text_col)


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode, with digests in place of ids and text."""
    return _mapped(docs, tokenizer_path, ["n_tokens", "ids_sha256", "decoded_sha256"], id_col, text_col)


def encoded_with_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _mapped(docs, tokenizer_path, ["n_tokens", "ids_sha256", "decoded_sha256", "ids"], id_col, text_col)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_pair_index_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path or default_path())
