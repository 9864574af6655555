import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import token_store as S

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 5000), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(gaps):
    values = np.cumsum(np.array(gaps, np.int64)) if gaps else np.zeros(0, np.int64)
    coded = S.EliasFano(S.EliasFano.encode(values))
    assert coded.all().tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert coded.select(i) == values[i]


TRICKY = ["", " ", "a  b", "it's DON'T 'S", "x² ½ ª º Ⅷ １２", "ΣΑΣ İstanbul", "été", "a b\x1cb", "<|endoftext|> mid<|startoftext|>x", "foo_bar__9,9..,", "日本語 \U0001f600", "\x00\x7f", "ŉ ǆ ſ Straße µ ¼", "a\r\n\tb", "--", "1234 12.3"]


@pytest.mark.parametrize("text", TRICKY)
def test_cached_tokenizer_equals_the_library(text):
    tok = S.CachedTokenizer(PATH)
    full = Tokenizer.from_file(PATH)
    assert np.frombuffer(tok.encode(text), tok.dtype).tolist() == full.encode(text, add_special_tokens=False).ids


@given(st.text(st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), max_size=40))
@settings(max_examples=400, deadline=None)
def test_cached_tokenizer_equals_the_library_on_any_text(text):
    tok = S._tokenizer(PATH)
    assert np.frombuffer(tok.encode(text), tok.dtype).tolist() == tok.full.encode(text, add_special_tokens=False).ids


def test_store_over_small_tables(spark, tmp_path):
    full = Tokenizer.from_file(PATH)
    rows = [(5, "b c"), (None, "x"), (3, None), (3, "twice"), (3, "twice"), (9, "long " * 3000), (1, "")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, start string")
    S.write_token_store(docs, str(tmp_path / "s"), PATH, block_tokens=64)
    got = [tuple(r) for r in S.digests(spark, str(tmp_path / "s")).collect()]
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    S.write_token_store(docs.limit(0), str(tmp_path / "e"), PATH)
    assert S.digests(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000])
def test_ranges_are_read_from_the_samples(n):
    g = np.random.default_rng(n)
    for top in (0, 3, 10**9):
        values = np.sort(g.integers(0, top + 1, n))
        ef = S.EliasFano(S.EliasFano.encode(values))
        assert ef.select_range(0, n).tolist() == values.tolist() == [ef.select(i) for i in range(n)]
        for _ in range(10):
            a, b = sorted(g.integers(0, n + 1, 2).tolist())
            assert ef.select_range(a, b).tolist() == values[a:b].tolist()
