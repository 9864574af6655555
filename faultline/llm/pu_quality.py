"""Operator 5. Quality by positive-unlabelled learning.

Trusted positives are labelled documents of good quality; the other side is unlabelled text of the corpus. The class prior of
good text among the unlabelled is estimated as the least ratio of unlabelled to positive mass over top regions of a
positive-against-unlabelled score. A logistic model on surface statistics of the whole text minimises the non-negative
unbiased risk: prior * positive loss + max(0, unlabelled loss - prior * positive loss as negatives).

Training takes at most MAX_POSITIVE positives and MAX_UNLABELLED documents (the first by a hash of doc_id), none of the
held-out third; negative labels are not used.

Nulls: rows with a null label or doc_id teach nothing. A text without words, null included, scores 0. Without positives or
unlabelled documents every score is 0.5 for texts with words. Repeated rows are scored alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_column, fold_of, shingle_hashes, table, word_hashes, word_spans
from .toxicity_gru import sample_labelled, sigmoid

MAX_POSITIVE, MAX_UNLABELLED = 4000, 6000
#: Added to the number of words where repetition is a share of it, so that one repeated word does not mark a short text.
PRIOR_WORDS = 20
_PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True


def statistics(text: str | None) -> np.ndarray | None:
    """Surface statistics of a whole text: shares of characters, repetition of words, word groups and lines, lengths. None without words."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends = word_spans(data)
    n = len(starts)
    if not n:
        return None
    count = np.bincount(data, minlength=256)
    words = word_hashes(data, starts, ends)
    sizes = ends - starts
    distinct, times = np.unique(words, return_counts=True)
    lines = np.flatnonzero(data == 10)
    line_of = np.searchsorted(lines, starts)
    first = np.flatnonzero(np.append(True, line_of[1:] != line_of[:-1]))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(words * (np.arange(n, dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, n))).astype(np.uint64) + np.uint64(1)), first)
    same = (words[1:] == words[:-1]).sum() / (n + PRIOR_WORDS)
    triple = shingle_hashes(words, 3)
    repeated = (len(triple) - len(np.unique(triple))) / (n + PRIOR_WORDS) if n >= 3 else 0.0
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    last = data[ends - 1]
    doubled = (last == data[np.maximum(ends - 2, starts)]) & (sizes > 1) & ~((last >= 65) & (last <= 90) | (last >= 97) & (last <= 122)) & (last < 128) & ~_DIGIT[last]
    rates = np.concatenate([
        count[_PUNCTUATION] / n,
        [count[_UPPER].sum() / letters, count[_DIGIT].sum() / len(data), count[128:].sum() / len(data), count[:32].sum() / n, same, repeated, (len(sums) - len(np.unique(sums))) / (len(sums) + 3), (times.max() - 1) / (n + PRIOR_WORDS), (n - len(distinct)) / (n + PRIOR_WORDS), (sizes == 1).mean(), doubled.mean()],
    ])
    return np.concatenate([np.log1p(50 * rates), [sizes.mean(), sizes.std(), np.log(n)]])


FEATURES = len(statistics("a"))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of unlabelled to positive mass at or above a score, over scores that keep a tenth of the positives or more."""
    cuts = np.quantile(positive, np.linspace(0.005, 0.9, 80))
    p = (positive[:, None] >= cuts).mean(0)
    u = (unlabelled[:, None] >= cuts).mean(0)
    slack = np.sqrt(u * (1 - u) / len(unlabelled) + p * (1 - p) / len(positive)) / p
    return float(np.clip((u / p + slack).min(), 0.05, 0.99))


def _fit(x: np.ndarray, gradient, rounds: int, rate: float = 0.05, ridge: float = 1e-3) -> np.ndarray:
    """Adam on weights (last: bias); gradient(scores) gives d risk / d score."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, rounds + 1):
        g = x.T @ gradient(x @ w) + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


class QualityModel:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def _rows(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z - 1, np.ones((len(z), 1))], 1)

    @staticmethod
    def train(positive: list[str], unlabelled: list[str], rounds: int = 600) -> QualityModel | None:
        p, u = ([s for s in map(statistics, texts) if s is not None] for texts in (positive, unlabelled))
        if not p or not u:
            return None
        p, u = np.array(p), np.array(u)
        model = QualityModel(p.mean(0), p.std(0) + 0.05, np.zeros(0), 0.5)
        x = np.concatenate([model._rows(p), model._rows(u)])
        is_p = np.arange(len(x)) < len(p)
        n_p, n_u = len(p), len(u)
        # positives against unlabelled on one half, the prior on the other
        half = np.arange(len(x)) % 2 == 0
        side = np.where(is_p, 1 / max(1, (is_p & half).sum()), 1 / max(1, (~is_p & half).sum()))[half] / 2
        w = _fit(x[half], lambda s: side * (sigmoid(s) - is_p[half]), rounds // 2)
        rest = x[~half] @ w if (is_p & ~half).any() and (~is_p & ~half).any() else x @ w
        of_p = is_p[~half] if len(rest) < len(x) else is_p
        prior = class_prior(rest[of_p], rest[~of_p])

        def risk(s: np.ndarray) -> np.ndarray:
            """Gradient of the non-negative risk; where its negative part falls below 0, that part is stepped back up."""
            q = sigmoid(s)
            negative = np.logaddexp(0, s)
            part = negative[n_p:].mean() - prior * negative[:n_p].mean()
            g = np.empty(len(s))
            if part >= 0:
                g[:n_p] = prior * (q[:n_p] - 1) / n_p - prior * q[:n_p] / n_p
                g[n_p:] = q[n_p:] / n_u
            else:
                g[:n_p] = prior * q[:n_p] / n_p
                g[n_p:] = -q[n_p:] / n_u
            return g

        model.weights, model.prior = _fit(x, risk, rounds), prior
        return model

    def scores(self, texts: list[str | None]) -> np.ndarray:
        stats = [statistics(t) for t in texts]
        out = np.zeros(len(texts))
        have = [i for i, s in enumerate(stats) if s is not None]
        if have:
            out[have] = sigmoid(self._rows(np.array([stats[i] for i in have])) @ self.weights)
        return out


def sample_unlabelled(docs: DataFrame, most: int) -> list[str]:
    """Texts of the first documents by hash of doc_id, none of the held-out third."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").filter(fold_column(F.col("doc_id")) != 1).distinct()
    chosen = ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").collect()
    return [r.text or "" for r in sorted(rows, key=lambda r: (r.doc_id, r.text or ""))]


def trained(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> QualityModel | None:
    positive = [t for t, _ in sample_labelled(docs, labels, "quality", {1: max_positive})]
    return QualityModel.train(positive, sample_unlabelled(docs, max_unlabelled))


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def scored(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id, held_out, score, predicted. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                s = model.scores(texts) if model else np.array([0.5 if t and t.split() else 0.0 for t in texts])
                held = [d is not None and fold_of(d) == 1 for d in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))
