import random
import re
from collections import Counter

from faultline.llm import simhash_decontam as S


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, percent=80):
    out = set()
    for d, text in docs:
        w = words(text)
        for item, t in items:
            v = words(t)
            if not v:
                continue
            k = min(5, len(v))
            b = bag(v, k)
            for s in range(max(1, len(w) - len(v) + 1)):
                a = bag(w[s : s + len(v)], k)
                low, high = sum((a & b).values()), sum((a | b).values())
                if low and 100 * low >= percent * high:
                    out.add((d, item))
                    break
    return out


def cases():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 8, 20, 60])))) for i in range(25)]
    items += [(50, "x y " * 15), (51, None), (52, ""), (53, items[0][1])]
    docs = []
    for i in range(150):
        w = [r.choice(vocab) for _ in range(r.randint(0, 150))]
        if i % 2:
            own = r.choice(items)[1] or ""
            own = own.upper().split() if i % 3 else own.split()
            for _ in range(i % 5):
                if own and r.random() < 0.5:
                    own[r.randrange(len(own))] = "zz"
            at = r.randint(0, len(w))
            w[at:at] = own
        docs.append((i, "\n".join(w)))
    return [*docs, (1000, None), (1001, ""), (1002, "x y " * 40), (1003, "noise " * 9000 + items[7][1])], items


def test_equals_brute_force(spark):
    docs, items = cases()
    got = S.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_moved_blocks_are_found(spark):
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    items, docs = [], []
    for i in range(12):
        w = r.sample(vocab, 100 + 7 * i)
        items.append((i, " ".join(w)))
        for turn in (30, 50, 70):
            noise = [r.choice(vocab) for _ in range(r.choice([0, 40, 6000]))]
            docs.append((len(docs), " ".join([*noise, *w[turn:], *w[:turn], *noise[:25]])))
        thirds = [w[:33], w[33:66], w[66:]]
        docs.append((len(docs), " ".join(sum(reversed(thirds), []))))
        docs.append((len(docs), " ".join(w[: len(w) * 19 // 20])))
    want = brute([(d, " ".join(words(t)[-300:])) for d, t in docs], items)
    got = S.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) >= 48 and want <= {(g.doc_id, g.item_id) for g in got}
    assert len(got) == len(want)


def test_index_finds_all_within_the_radius():
    docs, items = cases()
    index = S.ItemIndex(items)
    r = random.Random(1)
    long = [i for i, b in enumerate(index.bags) if len(b) > S.FEW]
    for p in index.prints[long]:
        q = p.copy()
        for bit in r.sample(range(S.BITS), S.RADIUS):
            q[bit // 8] ^= 1 << bit % 8
        want = {i for i, x in enumerate(index.prints) if i in long and sum(int(a ^ b).bit_count() for a, b in zip(x, q, strict=True)) <= S.RADIUS}
        assert set(index.found(q[None])[0].tolist()) == want and want


def test_items_of_repeated_words_with_other_tails(spark):
    """Heavy shingles: words repeated with a period of 1 to 6, some of them replaced or cut, at any similarity around the threshold."""
    r = random.Random(3)
    items, docs = [], []
    for period in range(1, 7):
        for n in (6, 9, 13, 21, 25, 33, 40, 60, 90):
            unit = [f"p{period}n{n}u{i}" for i in range(period)]
            item = (unit * n)[:n]
            items.append((len(items), " ".join(item)))
            for changed in (0, 1, 2, 3):
                for where in ("front", "end", "any"):
                    w = list(item)
                    for j in range(changed):
                        at = {"front": j, "end": n - 1 - j, "any": r.randrange(n)}[where]
                        w[at] = f"z{r.randrange(10**6)}"
                    around = [f"q{r.randrange(10**6)}" for _ in range(r.choice([0, 7]))]
                    docs.append((len(docs), " ".join(around + w + around)))
            docs.append((len(docs), " ".join((unit * n * 3)[: n * 2 + 1])))
    want = brute(docs, items)
    got = S.contaminated(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(g.doc_id, g.item_id) for g in got} == want and len(want) > 300


def test_the_worst_bag_loses_one_window_in_many():
    """The chance that one bit of two sets at the threshold differs, exactly, for all sizes that go by fingerprint."""
    from math import comb

    def differs(shared, a, b):
        def sign_sums(n):
            return {2 * i - n: comb(n, i) / 2**n for i in range(n + 1)}

        total = 0.0
        for s, p in sign_sums(shared).items():
            up = [sum(q for t, q in sign_sums(m).items() if s + t >= 0) for m in (a, b)]
            total += p * (up[0] * (1 - up[1]) + up[1] * (1 - up[0]))
        return total

    worst = 0.0
    for n in range(S.FEW + 1, 90):
        for m in range(n * 4 // 5, n + 1):
            shared = min(m, -(-80 * (n + m) // 180))
            q = differs(shared, m - shared, n - shared)
            worst = max(worst, sum(comb(S.BITS, i) * q**i * (1 - q) ** (S.BITS - i) for i in range(S.RADIUS + 1, S.BITS + 1)))
    assert worst < 1e-6


def test_parts_and_empty_tables(spark):
    docs, items = cases()
    held = spark.createDataFrame(items, "item_id long, text string")
    assert len(S.item_parts(held, 300)) > 3
    assert S.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), held.limit(0)).count() == 0
    assert S.contaminated(spark.createDataFrame([], "doc_id long, text string"), held).count() == 0
