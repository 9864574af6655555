import hashlib
import random
import zlib

import duckdb
import pytest

from faultline.llm import merkle_manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf string, idx int, n int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    trees = {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k, v in sorted(trees.items())}
    own = {k: levels([leaf(r) for r in v]) for k, v in trees.items()}
    top = levels([x[-1][0] for x in own.values()])
    out = []
    for at, (k, docs) in enumerate(trees.items()):
        for i, r in enumerate(docs):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            cur, proof, start = leaf((*r[:3], r[3] + 1, r[4]) if hit else r), "", [(own[k], i), (top, at)]
            for tree, j in start:
                for nodes in tree[:-1]:
                    sib = nodes[j ^ 1] if j ^ 1 < len(nodes) else ""
                    cur, proof, j = H(sib, cur) if j & 1 else H(cur, sib), proof + sib, j >> 1
            out.append((r[0], leaf(r), own[k][-1][0], top[-1][0], H(proof), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def some(n, langs, seed=0):
    rng = random.Random(seed)
    return [(i * 3, rng.choice(["src0", "é", "", None]), rng.choice(langs), rng.choice([None, i, 0]), rng.choice([None, "", "text", "ü" * 9, "y" * 40_000])) for i in range(n)]


def check(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "t", "l", 1, 2) for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, M.manifest(docs, **kw).collect()), key=str) == brute(rows)


@pytest.mark.parametrize(("n", "langs", "kw"), [
    (0, ["en"], {}), (1, [None], {}), (2, ["en"], {}), (3, ["en", None], {}), (257, ["en", "en", "de", "fr", None, ""], {}),
    (257, ["en", "en", "de", None], {"bits": 3}),  # one round of blocks
    (257, ["en", "en", "en", "de", "fr"], {"bits": 2, "top": 6}),  # several
    (130, [f"l{i}" for i in range(40)], {"bits": 2, "top": 5}),  # more langs than the driver takes
    (40, [f"l{i}" for i in range(40)], {"bits": 1, "top": 1}),
])
def test_equals_brute_force(spark, n, langs, kw):
    check(spark, some(n, langs), **kw)


def test_repeated_rows_null_ids_and_order(spark):
    rows = some(50, ["en", "de", None])
    rows += rows[:9] + [(None, "s", "en", 3, "a"), (None, "s", "en", 3, "b"), (None, "s", "en", 3, "a"), (-5, None, None, None, None), (10**17 + 1, "s", "en", 1, "x"), (10**17 + 2, "s", "en", 1, "x")]
    check(spark, rows, bits=3)
    check(spark, rows[::-1], bits=3, top=4)


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(*r, "t", "l", 1, 2) for r in some(300, ["en", "de"])], SCHEMA)
    got = M.manifest(docs, bits=4).collect()
    want = {i * 3 for i in range(300) if zlib.crc32(str(i * 3).encode()) % 7 == 0}
    failed = {r.doc_id for r in got if not r.verified}
    nulls = {r.doc_id for r in docs.filter("n_chars IS NULL").collect()}
    assert failed == want - nulls and len({r.root for r in got}) == 1


def test_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = M.op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"SELECT {', '.join(got.columns)} FROM ({M.ORACLE}) t").fetchall())
