"""The pipeline against plain Python: one document at a time, all pairs, whole sets."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from faultline.llm import pair_index_bpe, toxicity_gru, weak_pii

from .test_hyperminhash import brute as families
from .test_simhash_decontam import bag, words


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A third of the smallest tables, with nulls and repeats."""
    out = tmp_path_factory.mktemp("sf")
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "Reach me: a.b@mail1.example.com", "en", "s", 31), (9003, "Reach me: a.b@mail1.example.com", "en", "s", 31)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{src}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return str(out)


def test_run_equals_plain_python(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity_gru.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(d, t) for d, t in rows if model.scores([t])[0] < 0.7]
    rows = list(dict.fromkeys(rows))
    stay = {d for d, _, _, kept in families(rows, 5) if kept}
    rows = [(d, t) for d, t in rows if d in stay]
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def clean(text):
        w = words(text)
        for v in items:
            b = bag(v, 5)
            for s in range(max(1, len(w) - len(v) + 1)):
                a = bag(w[s : s + len(v)], 5)
                low = sum((a & b).values())
                if low and 5 * low >= 4 * (sum(a.values()) + sum(b.values()) - low):
                    return False
        return True

    rows = [(d, t) for d, t in rows if clean(t)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert sorted(got) == sorted(d for d, _ in rows)
    full = Tokenizer.from_file(pair_index_bpe.default_path())
    found = weak_pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {r.doc_id: [x.asDict() for x in r.spans] for r in found}
    for d, text in rows:
        assert {(s, e, k) for s, e, k in weak_pii.base_spans(text or "")} <= {(x["start"], x["stop"], x["kind"]) for x in spans[d]}
        left = weak_pii.masked_text(text, spans[d]) or ""
        ids = full.encode(left, add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(full.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    masked = full.encode("Reach me: [EMAIL]", add_special_tokens=False).ids
    assert got[9003].ids_sha256 == hashlib.sha256(np.array(masked, "<u4").tobytes()).hexdigest()
    assert got[9001].n_tokens == got[9002].n_tokens == 0


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema == docs.schema
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_clashing_columns_and_a_very_long_text(spark, sf_dir, tmp_path):
    """Columns with the names that operators use inside, and a text of 300,000 words."""
    names = ("node", "label", "n_shingles", "uid", "row", "spans", "base", "component_id", "kept", "score")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    long = spark.createDataFrame([(9100, " ".join(f"w{i}" for i in range(300_000)), "en", "s", 0)], docs.schema)
    docs = docs.unionByName(long).selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(names)])
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = docs.filter("doc_id = 9100").collect()
    assert len(rows) == 1 and rows[0].text.endswith("w299999") and [rows[0][n] for n in names] == list(range(len(names)))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).filter("doc_id = 9100").count() == 1
