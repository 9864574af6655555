import random

import numpy as np
import pyarrow.dataset as ds
import pytest

from faultline.llm import pu_quality as Q
from faultline.llm.common import fold_of

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows():
    docs = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in ds.dataset(f"{SF}/labels.parquet").to_table().to_pylist()}
    return [(r["doc_id"], r["text"], labels.get(r["doc_id"])) for r in docs]


def test_held_out_accuracy(rows):
    seen = [r for r in rows if fold_of(r[0]) != 1]
    model = Q.QualityModel.train([t for _, t, y in seen if y == 1], [t for _, t, _ in seen])
    held = [(t, y) for d, t, y in rows if fold_of(d) == 1 and y is not None]
    s = model.scores([t for t, _ in held])
    y = np.array([y for _, y in held])
    assert ((s >= 0.5) == y).mean() > 0.97
    assert (s[y == 1] >= 0.5).mean() > 0.98
    assert 0.8 < model.prior < 0.99


def test_prior_of_a_known_mixture():
    g = np.random.default_rng(2)
    p = g.normal(2, 1, 4000)
    for share in (0.3, 0.7, 0.9):
        u = np.where(g.random(6000) < share, g.normal(2, 1, 6000), g.normal(-2, 1, 6000))
        assert abs(Q.class_prior(p, u) - share) < 0.06


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 1), (2, " \n", 1), (2, " \n", 1), (3, "a", 1), (4, "b c " * 50000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    rows = Q.scored(docs, Q.trained(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert [r.predicted for r in rows if r.doc_id in (1, 2)] == [0, 0, 0]
    assert Q.scored(docs.limit(0), None).count() == 0


def test_statistics_read_the_whole_text():
    r = random.Random(1)
    words = ["".join(r.choices("abcdef", k=5)) for _ in range(4000)]
    assert not np.allclose(Q.statistics(" ".join(words)), Q.statistics(" ".join([*words, *["### |"] * 200])))
