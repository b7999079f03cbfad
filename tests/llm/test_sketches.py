"""Similarity sketches and the components of near duplicates against comparing all pairs."""

import random

import numpy as np

from lodestar.llm import sketches


def words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()


def shingles(text, k=4):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(docs):
    s, n = [shingles(t) for _, t in docs], len(docs)
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 80 * (len(s[i]) + len(s[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(root(i), []).append(d)
    of = [min((x for x in least[root(i)] if x is not None), default=None) for i in range(n)]
    return sorted(((d, len(s[i]), of[i], d == of[i]) for i, (d, _) in enumerate(docs)), key=str)


def run(spark, docs):
    df = spark.createDataFrame([(d, t, 1, "x", 2, "y") for d, t in docs], "doc_id long, text string, n_shingles long, t string, size int, kept string").repartition(3)
    return sorted((tuple(r) for r in sketches.near_components(df).collect()), key=str)


def test_chains_and_groups_of_copies(spark):
    r, docs = random.Random(5), []
    say = lambda n: [r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(n)]
    for size in (4, 6, 9, 30, 80, 500):
        for _ in range(3):
            now = say(size)
            for _ in range(6):  # each a few words away from the one before
                docs.append((r.randrange(10**6), " ".join(now)))
                now = list(now)
                for _ in range(max(1, size // 50)):
                    now[r.randrange(len(now))] = r.choice("XYZ") + str(r.randrange(99))
    base = say(200)
    for _ in range(120):  # a large group around one text, most pairs of it below the threshold
        now = list(base)
        for _ in range(r.randrange(9)):
            now[r.randrange(200)] = str(r.randrange(10**6))
        docs.append((r.randrange(10**6), " ".join(now)))
    shared = say(120)
    docs += [(r.randrange(10**6), " ".join(shared + say(r.randrange(20, 60)))) for _ in range(80)]  # around the threshold
    assert run(spark, docs) == brute(docs)


def test_nulls_short_texts_repeats_case_and_long_texts(spark):
    long = " ".join(f"w{k % 7000}v{k % 11}" for k in range(120_000))
    docs = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (None, "One  two"), (5, "ONE\ttwo"), (6, "one two"), (7, "one two three four"), (7, "ONE two three four"), (7, "something else entirely here"), (None, None), (8, "É b c d e"), (9, "é b c d e"), (10, long), (11, long + " end"), (11, long + " end"), (None, "all alone in here now"), (None, "all alone in here now"), (12, "x" * 200_000), (12, "a b c d e")]
    assert run(spark, docs) == brute(docs)


def test_empty_table_and_text_ids(spark):
    assert sketches.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([("b", "p q r s t"), ("a", "P q r s t"), ("c", None)], "doc_id string, text string")
    assert sorted(map(tuple, sketches.near_components(df).collect())) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 0, "c", True)]


def test_sketches_fill_every_coordinate_and_agree_like_the_similarity():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 150, 5000):
        s = r.integers(0, 2**63, n).astype(np.uint64)
        x = sketches.sketch(s)
        assert len(x) == sketches.T and (x < np.uint64(1 << 63)).all()
        assert (sketches.sketch(s[::-1]) == x).all()
    assert len(sketches.sketch(np.zeros(0, np.uint64))) == 0
    for n in (10, 100, 1000):
        same, met = [], 0
        for _ in range(200):
            u = r.integers(0, 2**63, n).astype(np.uint64)
            a, b = u[: n * 9 // 10], u[n // 10 :]  # similarity 0.8
            same.append((sketches.sketch(a) == sketches.sketch(b)).mean())
            met += bool(set(sketches.bands(a)) & set(sketches.bands(b)))
        assert abs(np.mean(same) - 0.8) < 0.01 and np.std(same) < 0.05 and met == 200
    assert sketches.missed(0.8) < 1e-5


def test_rounds_computed_together_are_rounds_one_by_one():
    s = np.random.default_rng(3).integers(0, 2**63, 40).astype(np.uint64)
    out = np.full(sketches.T, np.uint64((1 << 64) - 1))
    for i in range(2 * sketches.T):
        if (out < np.uint64((1 << 64) - 1)).all():
            break
        h = sketches._round_hashes(s, np.array([i]))[0]
        for x in h:
            b = int(x >> np.uint64(40)) * sketches.T >> 24 if i < sketches.T else i - sketches.T
            out[b] = min(out[b], np.uint64(i << 40) | (x & sketches._LOW))
    assert (out == sketches.sketch(s)).all()
