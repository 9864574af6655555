import re
import string
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import variant_groups as V

SCHEMA = "doc_id long, text string, word string, n int, key int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, count = {}, {}
    for w in n:
        others = sorted((-n[x], x) for x in n if near(w, x))
        count[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, V.variants(docs).collect()), key=str)
    assert got == brute(rows)
    return got


def said(**words):
    return " ".join(f"{w} " * n for w, n in words.items())


def test_equals_brute_force(spark):
    rows = [
        (1, said(colour=3, colours=6, colourss=13, Colour=4, kolour=3, clour=3, colouur=3)), (2, said(aabbb=3, abbbb=6, aaabb=6, ababb=3, bbbbb=12, aabbbb=3)), (None, said(Éclair=3, éclair=3, eclair=9, eclaire=3)),
        (3, None), (4, ""), (5, "a bb ccc dddd ÷×÷×÷ " * 4), (6, "abcde" * 20_000 + " " + ("abcde" * 20_000 + " ") * 3), (6, "abcde" * 20_000 + "x " + "z" * 50_000), (7, ("z" * 50_000 + " ") * 3 + ("z" * 50_001 + " ") * 9),
        (8, said(order=3, odrer=3, ordre=7, ordep=14, ordem=14)),
    ]
    got = check(spark, rows)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of forms
    check(spark, rows * 2)
    check(spark, [])
    check(spark, [(1, "few words here")])


def test_letters_that_are_lost(spark):
    """One (document, run) pair in 97 loses a letter."""
    rows = [(i, "information informations") for i in range(9000)]
    got = check(spark, rows)
    assert {r[0] for r in got} > {"information", "informations"}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé"), min_size=5, max_size=7), max_size=60))
def test_few_letters(spark, words):
    check(spark, [(0, " ".join(words * 3)), (1, " ".join(words[::2]))])


def test_keys_are_those_of_the_strings():
    import numpy as np

    texts = ["aabbc", "abbc", "éclair", "z" * 9, "xaabbc"]
    key, word, letters, first, last = V._entries(np.arange(len(texts)), texts)
    shown = {}
    for k, w, size, lo, hi in zip(key, word, letters, first, last, strict=True):
        made = {texts[w]} if lo < 0 else {texts[w][:i] + texts[w][i + 1 :] for i in range(lo, hi + 1)}
        assert len(made) == 1 and size == len(texts[w])
        assert shown.setdefault(k, made) == made
    assert len({frozenset(x) for x in shown.values()}) == len(shown)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = V.op12_variant_groups(spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(c.sql(f"SELECT {', '.join(got.columns)} FROM ({V.ORACLE}) t").fetchall(), key=str)
