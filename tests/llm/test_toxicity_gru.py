import random

import numpy as np
import pytest

from faultline.llm import toxicity_gru as G


def corpus(n, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(500)]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(5, 200))]
        toxic = int(r.random() < 0.3)
        if toxic:
            words[r.randrange(len(words))] = "zloq" + r.choice(vocab)[:3]
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(500, 1)
    return G.ToxicityModel.train([t for _, t, _ in rows], [y for *_, y in rows])


def test_held_out_accuracy(model):
    rows = corpus(300, 2)
    said = model.scores([t for _, t, _ in rows]) >= G.THRESHOLD
    assert (said == np.array([y for *_, y in rows], bool)).mean() > 0.95


def test_gradients_agree_with_differences():
    g = np.random.default_rng(0)
    net = G.GruNet(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = g.normal(size=(5, 3, 2 * G.DIM))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    gates = lambda: np.concatenate([x @ net.p["Wf"] + net.p["bf"], x @ net.p["Wb"] + net.p["bb"]], 2)
    keep = {}
    net.forward(gates(), mask, keep)
    weights = np.array([1.0, -2.0, 0.5])
    grads, dx = net.backward(keep, mask, x, weights)
    grads["x"] = dx
    for name, at in (("Uf", (2, 5)), ("Wb", (1, 20)), ("bf", (3,)), ("A", (4, 2)), ("v", (1,)), ("w", (9,)), ("x", (1, 2, 3))):
        p = x if name == "x" else net.p[name]
        old, out = p[at], []
        for e in (1e-4, -1e-4):
            p[at] = old + e
            out.append((net.forward(gates(), mask) * weights).sum())
        p[at] = old
        assert abs((out[0] - out[1]) / 2e-4 - grads[name][at]) < 2e-4, name


def test_windows_cover_all_words():
    for n in range(1, 200):
        covered = {i for s in G.window_starts(n) for i in range(s, min(n, s + G.WINDOW))}
        assert covered == set(range(n))


def test_a_toxic_word_counts_wherever_it_stands(model):
    long = ["abc"] * 30000
    clean = model.scores([" ".join(long)])[0]
    for at in (0, 15000, 29999):
        words = list(long)
        words[at] = "zloqabc"
        assert model.scores([" ".join(words)])[0] > max(G.THRESHOLD, clean)
    assert clean < G.THRESHOLD


def test_edge_cases(spark, model):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, "!!! \t", 0.5), (2, "!!! \t", 0.5), (3, "zloqabc", 0.5)], "doc_id long, text string, score double")
    rows = G.scored(docs, model).collect()
    assert len(rows) == 5 and sum(r.predicted for r in rows) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert G.scored(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (3, 1, 0)], "doc_id long, toxic int, quality int")
    assert G.trained(docs, labels) is None
    assert {r.score for r in G.scored(docs, None).collect()} == {0.0}


def test_labels_of_the_held_out_third_are_never_read(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(300)], "doc_id long, toxic int")
    n = len(G.sample_labelled(docs, labels, "toxic", {1: 1000, 0: 1000}))
    assert n == sum(G.fold_of(i) != 1 for i in range(300))


def test_a_toxic_string_counts_behind_a_long_unbroken_run(model):
    r = random.Random(4)
    run = "".join(r.choices("abcdefgh", k=600))
    clean, toxic = model.scores([run, run[:400] + "zloqabc" + run[400:]])
    assert clean < G.THRESHOLD < toxic


def test_pieces_cover_a_long_run():
    r = random.Random(5)
    for n in (201, 202, 207, 208, 209, 216, 1000):
        run = "".join(r.choices("abcdefgh", k=n))
        at, whole = 0, ""
        for piece in G.words_of(run):
            assert run[at : at + len(piece)] == piece
            whole = whole[:at] + piece
            at += G.PIECE_STEP
        assert whole == run
    assert G.words_of("a" * 200 + " \u4e00" + "b" * 190) == ["a" * 200, "\u4e00" + "b" * 190]
