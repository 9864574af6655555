import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import run_length_dedup as R


def brute(rows, length):
    seen = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=5), st.integers(1, 12))
def test_index_marks_exactly_the_repeated_strings(parts, length):
    count = {}
    for p in parts:
        for i in range(len(p) - length + 1):
            count[p[i : i + length]] = count.get(p[i : i + length], 0) + 1
    for p, got in zip(parts, R.repeated_starts(parts, length), strict=True):
        assert got.tolist() == [count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


def test_index_on_periodic_and_zero_bytes():
    for parts in ([b"a" * 5000], [b"ab" * 700, b"ba" * 30], [b"\0" * 40, b"\0" * 9], [b""], [b"x"]):
        count = {}
        for p in parts:
            for i in range(len(p) - 19):
                count[p[i : i + 20]] = count.get(p[i : i + 20], 0) + 1
        for p, got in zip(parts, R.repeated_starts(parts, 20), strict=True):
            assert got.tolist() == [count[p[i : i + 20]] > 1 for i in range(len(p) - 19)]


def test_runs_are_few_in_repetitive_text():
    g = np.random.default_rng(1)
    base = g.integers(97, 123, 2000, dtype=np.uint8)
    once, many = R.RunLengthIndex(base), R.RunLengthIndex(np.tile(base, 20))
    assert len(many.run_bytes) < 1.2 * len(once.run_bytes)


def test_segments_hold_every_string_once():
    g = np.random.default_rng(2)
    docs = [g.integers(97, 100, n, dtype=np.uint8).tobytes() for n in (0, 10, 100, 101, 700, 1500)] + [b"a" * 900]
    bounds = np.cumsum([0, *map(len, docs)])
    doc, lo, n, key, moves = R.segments_of(np.frombuffer(b"".join(docs), np.uint8), bounds, 100)
    held = [(d, s) for d, a, k in zip(doc, lo, n, strict=True) for s in range(a, a + k)]
    assert sorted(held) == [(d, s) for d, t in enumerate(docs) for s in range(len(t) - 99)]
    keys = {}
    for d, a, k, x in zip(doc, lo, n, key, strict=True):
        for s in range(a, a + k):
            assert keys.setdefault(docs[d][s : s + 100], x) == x
    assert moves[-1]


def corpus():
    r = random.Random(9)
    line = lambda n: "".join(r.choices("abcdefghij é", k=n))
    shared = [line(n) for n in (120, 180, 230, 400, 1500)]
    rows = []
    for i in range(60):
        parts = [line(r.randint(0, 400))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared)[r.choice([0, 0, 7]) :], line(r.randint(0, 300))]
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 1000), (103, "xyz" * 300), (104, rows[3][1]), (None, rows[4][1]), (5, line(500)), (5, line(500)), (106, "same " * 90), (106, "same " * 90), (107, line(40000))]
    return rows


@pytest.mark.parametrize("chunk", [R.CHUNK_BYTES, 2000, 240])
def test_equals_brute_force(spark, chunk):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, uid int")
    got = sorted((tuple(x) for x in R._removed(docs, R.LENGTH, True, chunk).collect()), key=str)
    assert got == brute(rows, R.LENGTH)


def test_outputs_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "q" * 500), (2, "w")], "doc_id long, text string")
    got = {x.doc_id: x for x in R.without_repeats(docs).collect()}
    assert bytes(got[1].kept) == b"" and [tuple(s) for s in got[1].spans] == [(0, 500)] and bytes(got[2].kept) == b"w"
    assert R.without_repeats(docs.limit(0)).count() == 0
