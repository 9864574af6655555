"""Operator 10. Personal data by weak supervision.

Base spans follow fixed patterns (kinds email, ip, card, phone) and always stay. Beyond them a looser generator proposes
candidates: number groups, secrets after a key word, hexadecimal strings, spelled-out addresses, and base spans themselves.
Labelers vote on each: pattern shape, gazetteers of key words and of reserved domains, and the words around it. Votes are
counted per vote pattern over the whole corpus; expectation-maximisation estimates each labeler's reliability from those
counts. A logistic span classifier is fitted to the resulting posteriors on counts per feature pattern, and decides on every
candidate. Candidates that it accepts, do not touch a base span, and do not overlap an earlier one are added (kinds phone_like,
secret, spelled_email, number). Votes and features take few values, so what reaches the driver is bounded by PATTERNS rows.

Nulls and empty texts have no spans; a null doc_id stays; repeated rows give the same spans each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @ back to where its local part can begin, so long words are not tried from each letter."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    out = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


#: Candidates beyond the base patterns.
LOOSE = re.compile(
    r"""(?P<secret>\b(?:password|passwd|pwd|secret|token|api[_-]?key|key)\b\s{0,3}[=:]\s{0,3}["']?(?P<value>[A-Za-z0-9_+/=.-]{8,}))"""
    r"""|(?P<number>(?<![\w+])\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,6})+(?!\w))"""
    r"""|(?P<hex>(?<!\w)[0-9a-f]{18,}(?!\w))""",
    re.I,
)
#: The tail of a spelled-out address; what stands before it is read backwards, so its length has no bound and costs no second look.
SPELLED = re.compile(r"\s?(?:\(at\)|\[at\]|\sat\s)\s?[a-z0-9-]+(?:\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[a-z0-9-]+)*\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[a-z]{2,}\b", re.I)
SPELLED_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")
PHONE_WORDS = re.compile(r"\b(?:tel|phone|call|mobile|fax|cell|whatsapp|telefon|teléfono|téléphone)\b", re.I)
ID_WORDS = re.compile(r"\b(?:ssn|social|iban|passport|account|konto|cuenta|compte|card|id)\b", re.I)
SECRET_WORDS = re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_-]?key|credential|bearer)\b", re.I)
CLEAN_WORDS = re.compile(r"\b(?:version|licen[cs]e|copyright|page|chapter|figure|isbn|year|section)\b", re.I)
CONTEXT = 40
LABELERS = ("shape", "gazetteer", "context", "entropy")
FEATURES = 12
#: Votes (3 ** labelers) times features (2 ** FEATURES): the most rows that the counts can have.
PATTERNS = 3 ** len(LABELERS) * 2**FEATURES


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Spelled-out addresses: a letter or digit, any more of SPELLED_LOCAL, and the tail."""
    last = 0
    for m in SPELLED.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in SPELLED_LOCAL:
            start -= 1
        while start < m.start() and text[start] in "._-":
            start += 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, tuple[int, ...], int]]:
    """(start, end, kind, votes of -1, 0, 1, feature bits). Kinds of base spans keep their names."""
    found = list(base)
    for m in LOOSE.finditer(text):
        kind = m.lastgroup if m["value"] is None else "secret"
        s, e = m.span("value") if kind == "secret" else m.span()
        found.append((s, e, {"hex": "secret", "number": "number"}.get(kind, kind)))
    found += [(s, e, "spelled_email") for s, e in _spelled(text)]
    out = []
    for s, e, kind in found:
        body, before, after = text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
        near = before + " " + after
        digits = sum(c.isdigit() for c in body)
        phone, ident, secret, clean = (bool(p.search(near)) for p in (PHONE_WORDS, ID_WORDS, SECRET_WORDS, CLEAN_WORDS))
        if kind == "number" and (7 <= digits <= 15) and phone:
            kind = "phone_like"
        mixed = digits >= 4 and any(c.isalpha() for c in body) and len(body) >= 12
        strict = kind in KINDS or kind == "spelled_email"
        shape = 1 if strict or mixed or (kind == "phone_like") else (-1 if digits < 7 else 0)
        gazetteer = 1 if phone or ident or secret else (-1 if clean else 0)
        context = -1 if clean else (1 if before.rstrip()[-1:] in ("=", ":", '"') or secret else 0)
        spread = len(set(body.lower())) / max(1, min(len(body), 36))
        entropy = 1 if spread > 0.4 and (len(body) >= 10) else (-1 if spread < 0.2 else 0)
        bits = [kind in KINDS, kind == "secret", kind == "number", kind == "phone_like", phone, ident, secret, clean, mixed, digits >= 7, spread > 0.4, len(body) >= 18]
        out.append((s, e, kind, (shape, gazetteer, context, entropy), sum(int(b) << i for i, b in enumerate(bits))))
    return out


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns. Returns P(vote | class) as (labelers, 2, 3), the class prior, and each pattern's posterior."""
    table = np.full((votes.shape[1], 2, 3), 1 / 3)
    table[:, 1], table[:, 0] = (0.15, 0.35, 0.5), (0.5, 0.35, 0.15)  # votes start out better than chance
    prior = 0.5
    post = np.zeros(len(votes))
    for _ in range(rounds):
        log = np.log([1 - prior, prior])[None] + sum(np.log(table[j][:, votes[:, j] + 1]).T for j in range(votes.shape[1]))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        w = np.stack([(1 - post) * counts, post * counts], 1)
        prior = float(np.clip(w[:, 1].sum() / w.sum(), 0.01, 0.99))
        for j in range(votes.shape[1]):
            for v in range(3):
                table[j, :, v] = w[votes[:, j] == v - 1].sum(0) + 1
            table[j] /= table[j].sum(1, keepdims=True)
    return table, prior, post


def span_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic weights (last: bias) by Newton steps on soft labels, ridge 1."""
    x = np.concatenate([(features[:, None] >> np.arange(FEATURES)) & 1, np.ones((len(features), 1), np.int64)], 1).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - target)) + w
        hess = (x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def accepted(weights: np.ndarray) -> np.ndarray:
    """A decision for each of the feature patterns."""
    bits = (np.arange(1 << FEATURES)[:, None] >> np.arange(FEATURES)) & 1
    return bits @ weights[:-1] + weights[-1] > 0


SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])
EXTRA = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("votes", pa.int32()), ("features", pa.int32())])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base_rows, extra_rows = [], []
        for text in batch.column(1):
            t = text.as_py() or ""
            base = base_spans(t)
            base_rows.append([{"start": s, "stop": e, "kind": k} for s, e, k in base])
            extra_rows.append([{"start": s, "stop": e, "kind": k, "votes": sum((v + 1) * 3**j for j, v in enumerate(votes)), "features": bits} for s, e, k, votes, bits in candidates(t, base)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_rows, pa.list_(SPAN)), pa.array(extra_rows, pa.list_(EXTRA))], names=["row", "base", "extra"])


def _chosen(decide: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, extra in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(b["start"], b["stop"], b["kind"]) for b in base]
                starts, furthest = [], []  # of base spans by start: the furthest end so far
                for s, e, _ in sorted(spans):
                    starts.append(s)
                    furthest.append(max(e, furthest[-1] if furthest else e))
                end = 0
                for x in sorted(extra, key=lambda x: (x["start"], -x["stop"])):
                    before = bisect_left(starts, x["stop"])
                    if x["kind"] not in KINDS and decide[x["features"]] and x["start"] >= end and (not before or furthest[before - 1] <= x["start"]):
                        spans.append((x["start"], x["stop"], x["kind"]))
                        end = x["stop"]
                rank = {k: i for i, k in enumerate((*KINDS, "phone_like", "secret", "spelled_email", "number"))}
                rows.append([{"start": s, "stop": e, "kind": k} for s, e, k in sorted(spans, key=lambda x: (x[0], rank[x[2]]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(SPAN))], names=["row", "base", "spans"])

    return run


def _decisions(proposals: DataFrame) -> np.ndarray:
    """What the span classifier decides for each feature pattern, from counts over all candidates."""
    counts = proposals.select(F.explode("extra").alias("x")).groupBy("x.votes", "x.features").count().collect()
    if not counts:
        return np.zeros(1 << FEATURES, bool)
    packed, features, n = (np.array([r[i] for r in counts], np.int64) for i in range(3))
    order = np.lexsort((features, packed))
    packed, features, n = packed[order], features[order], n[order].astype(float)
    votes = packed[:, None] // 3 ** np.arange(len(LABELERS)) % 3 - 1
    _, _, post = reliabilities(votes, n)
    return accepted(span_classifier(features, post, n))


KIND_ROWS = "array<struct<start:int,stop:int,kind:string>>"


def _proposals(docs: DataFrame) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(text.mapInArrow(_propose, f"row long, base {KIND_ROWS}, extra array<struct<start:int,stop:int,kind:string,votes:int,features:int>>"), "pii-candidates")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (those of base and the added ones) for each document."""
    proposals = _proposals(docs)
    return proposals.mapInArrow(_chosen(_decisions(proposals)), f"row long, base {KIND_ROWS}, spans {KIND_ROWS}").withColumnRenamed("row", "doc_id")


def masked(docs: DataFrame) -> DataFrame:
    """The documents with their spans masked in text; n_chars, where there is one, follows. Spans are found again beside the text, so no join is needed."""
    proposals = _proposals(docs)
    choose = _chosen(_decisions(proposals))
    discard(proposals)
    names = docs.columns
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.nulls(batch.num_rows, pa.int64())
            found = next(choose(_propose(iter([pa.RecordBatch.from_arrays([ids, batch.column(at_text)], names=["doc_id", "text"])]))))
            texts = [masked_text(t.as_py(), s) for t, s in zip(batch.column(at_text), found.column(2).to_pylist(), strict=True)]
            columns = list(batch.columns)
            columns[at_text] = pa.array(texts, batch.column(at_text).type)
            if "n_chars" in names:
                old = batch.column(names.index("n_chars"))
                columns[names.index("n_chars")] = pa.array([o if t is None else len(t) for t, o in zip(texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = lambda spans: ",".join(f"{x['kind']}:{x['start']}:{x['stop']}" for x in spans)
        base = batch.column(1).to_pylist()
        columns = [pa.array([sum(x["kind"] == k for x in b) for b in base], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([hashlib.sha256(told(b).encode()).hexdigest() for b in base]), pa.array([told(s) for s in batch.column(2).to_pylist()], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).mapInArrow(_digest, DIGEST)


def masked_text(text: str | None, spans: list[dict]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced, named by the first."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, stop, kind = spans[i]["start"], spans[i]["stop"], spans[i]["kind"]
        while i + 1 < len(spans) and spans[i + 1]["start"] < stop:
            i += 1
            stop = max(stop, spans[i]["stop"])
        out += [text[at:start], f"[{kind.upper()}]"]
        at, i = stop, i + 1
    return "".join([*out, text[at:]])
