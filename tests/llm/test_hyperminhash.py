import random
import re

import numpy as np
import pytest

from faultline.llm import hyperminhash as H


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), d is not None and d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, k):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    return sorted((tuple(r) for r in H.near_duplicates(docs, k).collect()), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_families_of_near_copies(spark, k):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([3, 12, 60, 400]))]
        for _ in range(r.choice([1, 4, 12])):
            own = list(base)
            for _ in range(r.randrange(0, max(1, len(own) // 12))):
                own[r.randrange(len(own))] = r.choice(vocab)
            rows.append((len(rows), " ".join(own).upper() if r.random() < 0.3 else "\n".join(own)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "solo"), (904, "SOLO"), (None, "solo"), (905, "É é"), (906, "é É"), (2, rows[0][1]), (907, "a b " * 20000)]
    assert run(spark, rows, k) == brute(rows, k)


def test_a_chain_across_a_bucket(spark):
    """Members that link to each other but not to the smallest one, in buckets that all share."""
    base = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(base[: 100 - 6 * i] + [f"z{i}_{j}" for j in range(3 * i)])) for i in range(7)] * 2
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_empty_table(spark):
    assert run(spark, [], 2) == []


def test_estimate_follows_jaccard():
    g = np.random.default_rng(3)
    for j in (0.2, 0.5, 0.8, 0.95):
        errs = []
        for _ in range(30):
            n = 4000
            common = g.integers(0, 2**64, int(n * j), dtype=np.uint64)
            rest = g.integers(0, 2**64, n - len(common), dtype=np.uint64)
            a, b = np.concatenate([common, rest[::2]]), np.concatenate([common, rest[1::2]])
            errs.append(H.estimate(H.registers(a), H.registers(b))[0] - j)
        assert abs(np.mean(errs)) < 0.03
