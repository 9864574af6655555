import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import weak_pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and P.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a.@-+%_ ()0123456789é\n"), max_size=40))
def test_base_spans_equal_the_plain_patterns(text):
    assert P.base_spans(text) == plain(text)


def test_known_spans():
    text = "é\U0001f600 a.b+c@mail3.example.com. 1.2.3.4 256.1.1.1 x 4041894974608795 x +1 (988) 555-2485 x 4041894974608796 a@b@c.d"
    assert P.base_spans(text) == plain(text)
    assert [k for *_, k in P.base_spans(text)] == ["email", "ip", "card", "phone", "email"]


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + "(" * 300_000, "1 " * 150_000, "a@" * 150_000):
        P.base_spans(text)
        P.candidates(text, [])


def test_em_recovers_reliabilities():
    g = np.random.default_rng(1)
    truth = g.random(20000) < 0.3
    right = [0.95, 0.8, 0.7, 0.9]
    votes = np.stack([np.where(g.random(len(truth)) < 0.2, 0, np.where(g.random(len(truth)) < r, 1, -1) * np.where(truth, 1, -1)) for r in right], 1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    table, prior, post = P.reliabilities(patterns, counts.astype(float))
    assert abs(prior - 0.3) < 0.03
    assert ((post[inverse.ravel()] > 0.5) == truth).mean() > 0.93
    assert table[0, 1, 2] > table[2, 1, 2]


def test_query_and_edge_cases(spark):
    r = random.Random(2)
    rows = [(i, f"x {i} y password={'%018x' % r.getrandbits(72)} z" if i % 2 else f"call mail{i}@a.example.com at 10.0.0.{i}") for i in range(200)]
    rows += [(None, "a@b.c"), (900, None), (901, ""), (902, rows[1][1]), (902, rows[1][1]), (903, "w " * 60000 + "q@b.co")]
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, spans int")
    found = P.personal_data(docs)
    got = {(x.doc_id, x.base_sha256, x.spans) for x in found.mapInArrow(P._digest, P.DIGEST).collect()}
    assert len(got) == len(rows) - 1
    by = {d: (h, s) for d, h, s in got}
    for d, text in rows:
        want = ",".join(f"{k}:{s}:{e}" for s, e, k in plain(text))
        assert by[d][0] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(by[d][1].split(","))
    assert all("secret" in by[i][1] for i in range(1, 200, 2))
    assert P.personal_data(docs.limit(0)).count() == 0


def test_masking():
    text = "mail a@b.co or +1 (988) 555-2485."
    spans = [{"start": s, "stop": e, "kind": k} for s, e, k in P.base_spans(text)]
    assert P.masked_text(text, spans) == "mail [EMAIL] or [PHONE]."
    assert P.masked_text(None, []) is None


def test_long_secrets_are_proposed_whole():
    r = random.Random(6)
    token, digits = "".join(r.choices("abcXYZ019_-.", k=600)), "%0128x" % r.getrandbits(512)
    for text, secret in ((f"token={token} end", token), (f"see {digits} end", digits)):
        start = text.index(secret)
        assert (start, start + len(secret), "secret") in [c[:3] for c in P.candidates(text, [])]
    for text in ("a" * 300_000, "a" * 300_000 + "z", "token=" + "a" * 300_000, "token=" * 50_000):
        P.candidates(text, [])


def test_spelled_addresses_need_no_digit_near():
    for text in ("john AT example DOT com", "write to john (at) example (dot) com now", "JOHN at EXAMPLE dot ORG"):
        assert [c[2] for c in P.candidates(text, [])] == ["spelled_email"], text
    assert [c[2] for c in P.candidates("x abcdefabcdefabcdefab y", [])] == ["secret"]


def test_added_spans_are_right_and_most_are_found(spark):
    """Planted secrets, spelled addresses and telephone numbers among numbers that mean something else."""
    r = random.Random(12)
    rows, wanted = [], {}
    for i in range(1200):
        kind = i % 6
        value = {0: "".join(r.choices("abcdef0123456789", k=32)), 1: f"anna{i} at mail{i} dot org", 2: f"{r.randint(200, 999)} {r.randint(200, 999)} {r.randint(1000, 9999)}"}.get(kind)
        if kind == 0:
            before, after = r.choice(["api_key = ", "password: ", "token="]), " kept"
        elif kind == 1:
            before, after = "write to ", " soon"
        elif kind == 2:
            before, after = r.choice(["call ", "phone: ", "tel "]), " today"
        else:
            before, after = {3: ("chapter ", f"{r.randint(1, 20)}.{r.randint(1, 9)} of the book"), 4: ("in the year ", f"{r.randint(1900, 2020)}-{r.randint(10, 12)}"), 5: ("version ", f"{r.randint(1, 9)}.{r.randint(10, 40)}.{r.randint(10, 99)}")}[kind]
        text = f"line {i % 7}: {before}{value or ''}{after}"
        if value:
            start = text.index(value)
            wanted[i] = (start, start + len(value))
        rows.append((i, text))
    got = {x.row if "row" in x else x.doc_id: [(s["start"], s["stop"]) for s in x.spans if s["kind"] not in P.KINDS] for x in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(span in got[i] for i, span in wanted.items())  # from the first to the last character
    wrong = sum(len(v) for v in got.values()) - hits
    assert hits >= 0.9 * len(wanted)
    assert hits >= 0.9 * (hits + wrong)


def test_added_spans_have_no_longest_one():
    for value, before, after in (("x" * 89, "to ", ""), ("a.b-c_" * 3000 + "z", "to ", "")):
        text = f"{before}{value} at mail dot example dot org{after} now"
        assert [c[:3] for c in P.candidates(text, [])] == [(len(before), len(text) - 4, "spelled_email")]
    number = " ".join(str(i % 90 + 10) for i in range(5000))
    assert [c[:2] for c in P.candidates(f"x {number}; y", [])] == [(2, 2 + len(number))]
    assert [c[2] for c in P.candidates("11 22 33 44 55 66 77 88 99", [])] == ["number"]
    long = "m" * 300 + " at " + "n" * 300 + " dot " + "o" * 300
    assert [c[:3] for c in P.candidates(long, [])] == [(0, len(long), "spelled_email")]
    assert not P.candidates("... at home dot com"[3:], []) and not P.candidates("._- at x", [])


def test_candidates_are_found_in_linear_time():
    import time

    for text in ("a." * 200_000, "a at " * 100_000, "a at b dot " * 60_000, "12 " * 200_000 + "x", "12-" * 200_000, "b (at) c" * 60_000):
        began = time.process_time()
        P.candidates(text, [])
        assert time.process_time() - began < 20


def test_choice_is_linear_and_spans_do_not_touch():
    decide = np.ones(1 << P.FEATURES, bool)
    text = "token=abcdefgh1 " * 20_000 + "a@b.co"
    base = P.base_spans(text)
    extra = [{"start": s, "stop": e, "kind": k, "votes": 0, "features": f} for s, e, k, _, f in P.candidates(text, base)]
    batch = pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([[{"start": s, "stop": e, "kind": k} for s, e, k in base]], pa.list_(P.SPAN)), pa.array([extra], pa.list_(P.EXTRA))], names=["row", "base", "extra"])
    spans = next(P._chosen(decide)(iter([batch]))).column(2).to_pylist()[0]
    assert len(spans) == 20_001 and all(a["stop"] <= b["start"] for a, b in zip(spans, spans[1:], strict=False))
