"""Operator 9. Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a word embedding beside the mean embedding of its character 3- to 5-grams (both hashed). Both directions of a
gated recurrent layer read windows of WINDOW words, every STRIDE words; attention pools their states into a logit. A document's
score is that of its highest window; all windows of the whole text count. A run of more than LONGEST bytes (text without white
space, say) enters as consecutive overlapping pieces.

Training takes at most MAX_TOXIC toxic and MAX_CLEAN clean labelled documents (the first by a hash of doc_id), none of the
held-out third. Embeddings start from shrunk log-odds of words and character groups in them. In training, too, a document is all
of its windows: each step scores them, and the highest carries the loss.

Nulls: rows with a null label or doc_id teach nothing; a text without words, null included, scores 0. Without both classes to
learn from, every score is 0. Repeated rows are scored alike. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_column, fold_of, mix64, table

WINDOW, STRIDE = 32, 24
HIDDEN, DIM = 8, 6
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 16
MAX_TOXIC, MAX_CLEAN = 1500, 6000
#: Windows that training scores at once.
AT_ONCE = 4096
#: So often the loss on a set-aside part of the training documents is taken; the parameters with the least are kept.
CHECK_STEPS = 32
#: Steps of embeddings against those of the layers: small, or single documents are learnt by heart.
EMBEDDING_RATE = 5
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
#: Bytes of the longest run that is one word; characters of the pieces of a longer one, and from one piece to the next.
LONGEST = 200
PIECE, PIECE_STEP = 16, 8


def words_of(text: str | None) -> list[str]:
    words = WORD.findall(text.lower()) if text else []
    if words and 4 * max(map(len, words)) > LONGEST:
        return [piece for w in words for piece in pieces_of(w)]
    return words


def pieces_of(word: str) -> list[str]:
    """The word itself, or overlapping pieces that cover all of a longer one."""
    if len(word.encode()) <= LONGEST:
        return [word]
    return [word[at : at + PIECE] for at in range(0, len(word) - (PIECE - PIECE_STEP), PIECE_STEP)]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its row; and of all words in a row: character-group rows with their starts. Groups are 3 to 5 bytes of <word>."""
    raw = [b"<" + w.encode() + b">" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raw])
    ends = np.cumsum(sizes)
    stop = np.repeat(ends, sizes)
    at = np.arange(len(data))
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, owners = [], []
    h = data.copy()
    with np.errstate(over="ignore"):
        for k in range(2, 6):
            h = h[: len(data) - k + 1] * np.uint64(0x100000001B3) + data[k - 1 :] if len(data) >= k else h[:0]
            if k >= 3 and len(h):
                fits = at[: len(h)] + k <= stop[: len(h)]
                rows.append((mix64(h[fits] + np.uint64(k)) % np.uint64(GRAM_ROWS)).astype(np.int64))
                owners.append(owner[: len(h)][fits])
        whole = np.zeros(len(words), np.uint64)
        weight = np.ones(len(words), np.uint64)
        for j in range(int(sizes.max()) if len(sizes) else 0):
            has = sizes > j
            whole[has] += data[(ends - sizes)[has] + j] * weight[has]
            weight *= np.uint64(0x9E3779B97F4A7C15)
    owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owners, kind="stable")
    rows = (np.concatenate(rows) if rows else np.zeros(0, np.int64))[order]
    return (mix64(whole) % np.uint64(WORD_ROWS)).astype(np.int64), rows, np.searchsorted(owners[order], np.arange(len(words)))


def window_starts(n: int) -> np.ndarray:
    """Overlapping windows that cover all n words."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GruNet:
    """Parameters and both passes. Gates stand in the order update, reset, candidate."""

    def __init__(self, seed: int = 11):
        g = np.random.default_rng(seed)
        f = lambda *s: (g.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": 0.05 * f(WORD_ROWS, DIM) * np.sqrt(WORD_ROWS), "C": 0.05 * f(GRAM_ROWS, DIM) * np.sqrt(GRAM_ROWS)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        for d in "fb":
            self.p |= {f"W{d}": f(2 * DIM, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": f(2 * HIDDEN, HIDDEN), "v": f(HIDDEN), "w": f(2 * HIDDEN), "c": np.full(1, -1, np.float32)}

    def inputs(self, features: tuple) -> np.ndarray:
        """A row for each word: word embedding, mean of its character-group embeddings."""
        word, grams, starts = features
        counts = np.diff(np.append(starts, len(grams)))
        return np.concatenate([self.p["E"][word], np.add.reduceat(self.p["C"][grams], starts) / counts[:, None]], 1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Both directions' input parts of the gates, side by side."""
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], 1)

    def _scan(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction, (time, rows, HIDDEN)."""
        steps, rows = mask.shape
        u, h = self.p[f"U{d}"], np.zeros((rows, HIDDEN), np.float32)
        out = np.empty((steps, rows, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            g = gates[t]
            zr = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            new = h + m * (1 - z) * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN :], m))
            out[t] = h = new
        return out

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; gates (time, rows, 6 * HIDDEN), mask (time, rows) of 0 and 1."""
        kept = {d: [] if keep is not None else None for d in "fb"}
        h = np.concatenate([self._scan(gates[:, :, : 3 * HIDDEN], mask, "f", kept["f"]), self._scan(gates[:, :, 3 * HIDDEN :], mask, "b", kept["b"])], 2)
        q = np.tanh(h @ self.p["A"])
        s = np.where(mask > 0, q @ self.p["v"], -1e9)
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"h": h, "q": q, "a": a, "pooled": pooled, "scan": kept}
        return pooled @ self.p["w"] + self.p["c"][0]

    def backward(self, k: dict, mask: np.ndarray, x: np.ndarray, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of the inputs x (time, rows, 2 * DIM)."""
        h, q, a, p = k["h"], k["q"], k["a"], self.p
        g = {"w": k["pooled"].T @ dlogit, "c": np.array([dlogit.sum()])}
        dpool = dlogit[:, None] * p["w"]
        dh = a[:, :, None] * dpool
        da = (h * dpool).sum(2)
        ds = a * (da - (a * da).sum(0))
        g["v"] = (q * ds[:, :, None]).sum((0, 1))
        dq = ds[:, :, None] * p["v"] * (1 - q * q)
        g["A"] = np.einsum("tbi,tbj->ij", h, dq)
        dh += dq @ p["A"].T
        dx = np.zeros_like(x)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u = p[f"U{d}"]
            gu, gw, gb = np.zeros_like(u), np.zeros_like(p[f"W{d}"]), np.zeros(3 * HIDDEN, np.float32)
            carry = np.zeros_like(dh[0, :, part])
            for t, prev, z, r, n, hn, m in reversed(k["scan"][d]):
                total = dh[t, :, part] + carry
                step = total * m
                dn = step * (1 - z) * (1 - n * n)
                dz = -step * (n - prev) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dgate = np.concatenate([dz, dr, dn], 1)
                dhu = np.concatenate([dz, dr, dn * r], 1)
                carry = total - step * (1 - z) + dhu @ u.T
                gu += prev.T @ dhu
                gw += x[t].T @ dgate
                gb += dgate.sum(0)
                dx[t] += dgate @ p[f"W{d}"].T
            g |= {f"U{d}": gu, f"W{d}": gw, f"b{d}": gb}
        return g, dx


def _odds(counts: np.ndarray, totals: list[int]) -> np.ndarray:
    """Log-odds of a row in toxic against clean documents, shrunk towards 0 for rare ones."""
    clean, toxic = counts
    odds = np.log((toxic + 0.5) / (totals[1] + 1)) - np.log((clean + 0.5) / (totals[0] + 1))
    return odds * (toxic + clean) / (toxic + clean + 10)


class ToxicityModel:
    def __init__(self, net: GruNet):
        self.net = net
        self.memo: dict[str, int] = {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)

    CAPACITY = 80_000

    def forget(self) -> None:
        """Drops what is kept per word, so that an idle Python worker holds no more than the parameters."""
        self.memo, self.gates = {}, np.zeros((0, 6 * HIDDEN), np.float32)

    def __getstate__(self):
        return {"net": self.net}

    def __setstate__(self, state):
        self.__init__(state["net"])

    @staticmethod
    def train(texts: list[str], toxic: list[int], clean_weight: float = 1.0, seed: int = 11, steps: int = 320, batch: int = 128) -> ToxicityModel | None:
        y = np.array(toxic, np.float32)
        if not len(y) or y.min() == y.max():
            return None
        g = np.random.default_rng(seed)
        held = g.random(len(y)) < (0.15 if min(y.sum(), (1 - y).sum()) >= 40 else 0)
        totals = [int((1 - y[~held]).sum()), int(y[~held].sum())]
        by_word, by_gram = np.zeros((2, WORD_ROWS)), np.zeros((2, GRAM_ROWS))
        for t, label, out in zip(texts, toxic, held, strict=True):
            if not out and (own := sorted(set(words_of(t)))):
                word, grams, _ = word_features(own)
                by_word[label][np.unique(word)] += 1
                by_gram[label][np.unique(grams)] += 1
        net = GruNet(seed)
        net.p["E"][:, 0] = _odds(by_word, totals) / 4
        net.p["C"][:, 0] = _odds(by_gram, totals) / 2
        windows, owner = [], []
        vocab: dict[str, int] = {}
        for i, t in enumerate(texts):
            if words := words_of(t):
                ids = np.array([vocab.setdefault(w, len(vocab)) for w in words], np.int32)
                own = [ids[b : b + WINDOW] for b in window_starts(len(words)).tolist()]
                windows += own
                owner += [i] * len(own)
        if not windows:
            return None
        known, parts, sizes_of = list(vocab), [], []
        del vocab
        for at in range(0, len(known), 20_000):  # in parts, as what is worked with is many times what stays
            rows, groups, s = word_features(known[at : at + 20_000])
            parts.append((rows.astype(np.uint16), groups.astype(np.uint16)))
            sizes_of.append(np.diff(np.append(s, len(groups))))
        del known
        word, grams = (np.concatenate([p[i] for p in parts]) for i in range(2))
        bounds = np.cumsum(np.concatenate([[0], *sizes_of]))
        del parts, sizes_of
        owner = np.array(owner)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        have = np.flatnonzero(np.diff(first))
        check, have = have[held[have]], have[~held[have]]
        weight = np.where(y > 0, 1, clean_weight).astype(np.float32)

        def laid(chosen: list[int]) -> tuple:
            """Inputs of some windows: words used, their features and rows, places, mask, gates."""
            rows = [windows[j] for j in chosen]
            used, flat = np.unique(np.concatenate(rows), return_inverse=True)
            mask = (np.arange(WINDOW)[:, None] < np.array([len(r) for r in rows])).astype(np.float32)
            index = np.zeros((len(rows), WINDOW), np.int64)
            index[mask.T > 0] = flat
            sizes = bounds[used + 1] - bounds[used]
            feats = word[used], np.concatenate([grams[bounds[i] : bounds[i + 1]] for i in used]), np.cumsum(sizes) - sizes
            table_x = net.inputs(feats)
            x = table_x[index.T]
            return feats, sizes, table_x, index.T, mask, x

        def gates_of(x: np.ndarray) -> np.ndarray:
            return np.concatenate([x @ net.p["Wf"] + net.p["bf"], x @ net.p["Wb"] + net.p["bb"]], 2)

        def highest(own: np.ndarray) -> tuple[list[int], np.ndarray]:
            """The highest of all windows of some documents, and its logit."""
            every = [j for i in own for j in range(first[i], first[i + 1])]
            used, flat = np.unique(np.concatenate([windows[j] for j in every]), return_inverse=True)
            sizes = bounds[used + 1] - bounds[used]
            table = net.projected(net.inputs((word[used], np.concatenate([grams[bounds[i] : bounds[i + 1]] for i in used]), np.cumsum(sizes) - sizes)))
            lengths = np.array([len(windows[j]) for j in every])
            starts = np.cumsum(lengths) - lengths
            logits = []
            for at in range(0, len(every), AT_ONCE):
                n = lengths[at : at + AT_ONCE]
                mask = (np.arange(WINDOW)[:, None] < n).astype(np.float32)
                where = np.minimum(starts[at : at + AT_ONCE] + np.arange(WINDOW)[:, None], len(flat) - 1)
                logits.append(net.forward(table[flat[where]], mask))
            logit = np.concatenate(logits)
            cuts = np.cumsum([0, *(first[own + 1] - first[own])])[:-1]
            high = [int(c + np.argmax(logit[c:e])) for c, e in zip(cuts, [*cuts[1:], len(logit)], strict=True)]
            return [every[h] for h in high], logit[high]

        def loss(own: np.ndarray) -> float:
            total = 0.0
            for at in range(0, len(own), batch):
                part = own[at : at + batch]
                top = highest(part)[1]
                total += float((weight[part] * np.logaddexp(0, np.where(y[part] > 0, -top, top))).sum())
            return total / weight[own].sum()

        best = None
        moments: dict[str, list] = {}
        step = 0
        while step < steps:
            g.shuffle(have)
            for at in range(0, len(have), batch):
                rate = 0.02 * 0.1 ** min(1, step / steps)
                own = have[at : at + batch]
                feats, sizes, table_x, index, mask, x = laid(highest(own)[0])
                keep: dict = {}
                top = net.forward(gates_of(x), mask, keep)
                dlogit = (weight[own] * (sigmoid(top) - y[own]) / weight[own].sum()).astype(np.float32)
                grads, dx = net.backward(keep, mask, x, dlogit)
                step += 1
                for name, grad in grads.items():
                    m = moments.setdefault(name, [np.zeros_like(net.p[name]), np.zeros_like(net.p[name])])
                    m[0] += 0.1 * (grad - m[0])
                    m[1] += 0.01 * (grad * grad - m[1])
                    net.p[name] -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                dword = np.zeros_like(table_x)
                np.add.at(dword, index[mask > 0], dx[mask > 0])
                np.add.at(net.p["E"], feats[0], -EMBEDDING_RATE * rate * dword[:, :DIM])
                np.add.at(net.p["C"], feats[1], np.repeat(-EMBEDDING_RATE * rate * dword[:, DIM:] / sizes[:, None], sizes, 0))
                if len(check) and step % CHECK_STEPS == 0:
                    now = loss(check)
                    if best is None or now < best[0]:
                        best = now, {k: v.copy() for k, v in net.p.items()}
        if best:
            net.p = best[1]
        return ToxicityModel(net)

    def _known(self, words: list[str]) -> np.ndarray:
        """Rows of the gate table for words; words not there yet are added together."""
        memo = self.memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if new:
            if len(memo) + len(new) > self.CAPACITY and memo:
                memo.clear()
                new = list(dict.fromkeys(words))
            base = len(memo)
            rows = [self.net.projected(self.net.inputs(word_features(new[i : i + 20_000]))) for i in range(0, len(new), 20_000)]
            self.gates = np.concatenate([self.gates[:base], *rows])
            memo.update(zip(new, range(base, base + len(new)), strict=True))
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None], rows: int = 1024) -> np.ndarray:
        """The highest window's score of each text."""
        out = np.full(len(texts), -np.inf)
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal pending, size
            if not pending:
                return
            words = [w for t in pending for w in t[1]]
            ids = np.append(self._known(words), 0)
            at = 0
            starts, stops, owner = [], [], []
            for i, w in pending:
                s = window_starts(len(w))
                starts.append(s + at)
                stops.append(np.minimum(s + WINDOW, len(w)) + at)
                owner.append(np.full(len(s), i))
                at += len(w)
            starts, stops, owner = np.concatenate(starts), np.concatenate(stops), np.concatenate(owner)
            for b in range(0, len(starts), rows):
                s, e = starts[b : b + rows], stops[b : b + rows]
                where = s + np.arange(WINDOW)[:, None]
                mask = (where < e).astype(np.float32)
                logit = self.net.forward(self.gates[ids[np.minimum(where, len(ids) - 1)]], mask)
                np.maximum.at(out, owner[b : b + rows], logit)
            pending, size = [], 0

        for i, t in enumerate(texts):
            w = words_of(t)
            if w:
                pending.append((i, w))
                size += len(w)
            if size > 60_000:
                flush()
        flush()
        return np.where(np.isneginf(out), 0.0, sigmoid(out))


def sample_labelled(docs: DataFrame, labels: DataFrame, column: str, limits: dict[int, int]) -> list[tuple[str, int]]:
    """(text, label) of the first documents by hash of each class, up to its limit; never of the held-out third."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(fold_column(F.col("doc_id")) != 1)
    chosen = None
    for label, most in limits.items():
        part = usable.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").collect()
    return [(r.text or "", r.label) for r in sorted(rows, key=lambda r: (r.doc_id, r.label, r.text or ""))]


def trained(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicityModel | None:
    rows = sample_labelled(docs, labels, "toxic", {1: max_toxic, 0: max_clean})
    toxic = sum(y for _, y in rows)
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold_column(F.col("doc_id").cast("long")) != 1)
    n, n_toxic = usable.agg(F.count("*"), F.sum("toxic")).first()
    # clean documents stand for those that the sample left out
    weight = (n - n_toxic) / n_toxic * toxic / (len(rows) - toxic) if 0 < toxic < len(rows) else 1.0
    return ToxicityModel.train([t for t, _ in rows], [y for _, y in rows], weight)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def scored(docs: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted. No shuffle; the model's size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                s = m.scores(part.column(1).to_pylist()) if m else np.zeros(part.num_rows)
                held = [d is not None and fold_of(d) == 1 for d in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        if m:
            m.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def op9_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))


def without_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array(m.scores(part.column(at_text).to_pylist()) < threshold)) if m else part
        if m:
            m.forget()

    return docs.mapInArrow(run, docs.schema)
