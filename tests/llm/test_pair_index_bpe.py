import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import pair_index_bpe as B

PATH = B.default_path()
FULL = Tokenizer.from_file(PATH)


def ids(text):
    return np.frombuffer(B.model(PATH).encode_batch([text])[0][0], "<u4").tolist()


TRICKY = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "it's we'll 'S", "aaaaaaaaaaaaaaaaa aaaaaaa", "x\t y", "été ÉTÉ", "<|endoftext|>", "a <|endoftext|> b\n<|endoftext|>", "日本語 \U0001f600 é", "\x00\x7f\x1c a\x1f", "1234 12.3", "a b  c", "a　 b", "hahahahahahahaha banananananan"]


@pytest.mark.parametrize("text", TRICKY)
def test_equals_the_library(text):
    want = FULL.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert B.model(PATH).decode(want) == FULL.decode(want, skip_special_tokens=False)


@given(st.lists(st.text(st.sampled_from("ab n'ts \n\té.,1"), max_size=60), max_size=8))
@settings(max_examples=200, deadline=None)
def test_equals_the_library_in_blocks(texts):
    got = B.model(PATH).encode_batch(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g, _ in got] == [e.ids for e in FULL.encode_batch(texts, add_special_tokens=False)] if texts else got == []
    assert [d.decode("utf-8", "replace") for _, d in got] == texts


@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_equals_the_library_on_any_text(text):
    assert ids(text) == FULL.encode(text, add_special_tokens=False).ids


def test_query_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in B.digests(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = FULL.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(FULL.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a", 1), (2, None, 1), (2, "", 1), (3, "x " * 50000, 1), (3, "x " * 50000, 1)], "doc_id long, text string, n_tokens int")
    got = B.encode(docs, PATH).collect()
    assert len(got) == 5
    assert {r.decoded for r in got} == {"a", "", "x " * 50000}
    assert B.encode(docs.limit(0), PATH).count() == 0
