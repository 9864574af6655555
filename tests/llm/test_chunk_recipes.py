import hashlib
import string

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import chunk_recipes as C
from faultline.llm.common import ascii_lower

SCHEMA = "doc_id long, text string, ids int, h string, keep_id string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    norm = [(i, (t or "").translate(LOWER)) for i, t in rows]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, 1, "h", "k") for i, t in rows], SCHEMA)
    assert sorted(map(tuple, C.groups(docs, **kw).collect()), key=str) == brute(rows)
    return docs


LONG = "A sentence of words. Another, longer one; " * 400
ROWS = [
    (1, LONG), (2, LONG.upper()), (3, LONG + "x"), (4, "x" + LONG), (5, ""), (6, None), (None, "Ab"), (7, "aB"), (8, "a b"), (9, "É" + LONG), (10, "é" + LONG),
    (11, "z" * 30_000), (12, "z" * 30_001), (13, "\U0001f600" * 5000), (13, "\U0001f600" * 5000), (14, LONG[:4096]), (15, LONG[:4097]), (16, "İΣς ABC"), (17, "İΣς abc"), (18, "\0\n.\n"),
]


def test_equals_brute_force(spark):
    check(spark, ROWS)
    check(spark, ROWS * 3)
    check(spark, [])
    check(spark, [(None, None), (None, "")])


def test_hashes_that_clash_are_told_apart(spark):
    """Identifiers stay exact if nearly all chunks share a hash."""
    check(spark, ROWS, digest=lambda c: F.pmod(F.xxhash64(c), F.lit(2)))
    check(spark, ROWS, digest=lambda c: F.lit(0).cast("long") + F.length(c) * 0, least=2, most=5)
    check(spark, [(1, "abab"), (2, "baba"), (3, "abba"), (4, "abab"), (5, "ab")], digest=lambda c: F.length(c).cast("long"), least=1, most=2)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.text(st.sampled_from("aAbB.\nÉéß\U0001f600"), max_size=9)), max_size=12))
def test_any_texts(spark, rows):
    check(spark, rows, least=2, most=4, digest=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))


def test_chunks_make_the_text(spark):
    docs = spark.createDataFrame([(t,) for _, t in ROWS if t is not None], "text string")
    got = docs.select("text", C.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r.c) == r.text and all(r.c) and max(map(len, r.c), default=0) <= C.MOST for r in got)
    # an edit changes the chunks around it only
    a, b = (set(spark.createDataFrame([(t,)], "t string").select(C.chunks(F.col("t")).alias("c")).first().c) for t in (LONG, LONG[:6000] + "new" + LONG[6000:]))
    assert len(b - a) <= 3


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=20))
def test_ascii_lower(spark, text):
    if not any("\ud800" <= c <= "\udfff" for c in text):
        assert spark.createDataFrame([(text,)], "t string").select(ascii_lower(F.col("t")).alias("x")).first().x == text.translate(LOWER)


def test_documents_that_stay_keep_their_columns(spark):
    docs = check(spark, ROWS)
    left = C.without_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 18}


def test_no_python_in_the_plan(spark):
    plan = C.op11_chunk_recipes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = C.op11_chunk_recipes(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"SELECT {', '.join(got.columns)} FROM ({C.ORACLE}) t").fetchall())
