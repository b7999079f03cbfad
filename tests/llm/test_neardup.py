"""The Jaccard join against comparing all pairs."""

import random

import numpy as np
import pytest

from lodestar.llm import neardup


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(docs):
    s, n = [shingles(t) for _, t in docs], len(docs)
    parent, links = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(s[i] & s[j])
            if (docs[i][1] or "") == (docs[j][1] or "") or s[i] and both * 5 >= 4 * (len(s[i]) + len(s[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least.setdefault(root(i), []).append(d)
    return sorted(((d, min((x for x in least[root(i)] if x is not None), default=None), links[i]) for i, (d, _) in enumerate(docs)), key=str)


def near_copies(seed):
    r, docs = random.Random(seed), []
    for size in (3, 5, 30, 80, 600, 700):
        base = [f"w{r.randint(0, 400)}" for _ in range(size)]
        for _ in range(r.randint(2, 12)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                w[r.randrange(len(w))] = f"z{r.randint(0, 9)}"
            docs.append((len(docs), " ".join(w)))
    return [*docs, (900, None), (901, ""), (902, "a b"), (902, "a b"), (903, "a  b"), (None, "a b")]


@pytest.mark.parametrize(("texts", "size", "node"), [(1024, 4 << 20, 64), (5, 4 << 20, 64), (1024, 3000, 2), (3, 900, 1)])
def test_small(spark, monkeypatch, texts, size, node):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
    monkeypatch.setattr(neardup, "NODE", node)
    docs = near_copies(texts + size)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, t long")
    assert sorted((tuple(r) for r in neardup.jaccard_join(df).collect()), key=str) == brute(docs)
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted({c for _, c, _ in brute(docs)}, key=str)


def test_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in neardup.op3_jaccard_join(spark, sf).collect()), key=str) == brute(docs)


def test_empty_table(spark):
    assert neardup.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def recall_of(cut, threshold):
    low, _, deep = neardup.depths(threshold)
    return 1 - np.exp(-sum(neardup.gain(threshold, deep - c) for c in cut))


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_prefixes_are_shortened_until_the_recall_and_no_further(threshold):
    r = np.random.default_rng(7)
    wide4 = r.random((300, neardup.TREES)) < r.random((300, 1))
    wide5 = wide4 & (r.random(wide4.shape) < 0.5)
    wide4[0], wide5[0], wide4[1], wide5[1] = False, False, True, True
    for cut, w5, w4 in zip(neardup.choose(wide5, wide4, threshold), wide5, wide4):
        assert recall_of(cut, threshold) >= neardup.RECALL
        last = [(cut - np.eye(neardup.TREES, dtype=int)[k]) for k in np.flatnonzero(cut)]
        assert min(recall_of(c, threshold) for c in last) < neardup.RECALL  # some step was the last one needed
        if (w5 & (cut > 0)).any():  # wide nodes only when the small ones are used up
            assert cut[~w5].min(initial=1) >= 1 and (cut[~w4] == 2).all()


def test_forest_finds_pairs_at_the_threshold():
    r, met, n = np.random.default_rng(11), 0, 3000
    cut = neardup.choose(np.zeros((1, neardup.TREES), bool), np.zeros((1, neardup.TREES), bool))[0]
    for _ in range(n):
        x = r.integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2)
        a, b = (neardup.labels(s) for s in (x[:90], x[10:]))  # similarity 0.8
        same = (a[0] == b[0]).astype(int) + ((a[0] == b[0]) & (a[1] >> 16 == b[1] >> 16)) + ((a[0] == b[0]) & (a[1] == b[1]))
        met += bool((same >= 3 - cut).any())
    assert met >= n - 3


def test_overlaps_count_what_sets_share():
    r = np.random.default_rng(3)
    for _ in range(30):
        sets = [np.unique(r.integers(0, 40, r.integers(0, 30))) for _ in range(r.integers(1, 20))]
        got = neardup.overlaps(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), len(sets))
        assert all(got[i, j] == len(np.intersect1d(a, b)) or len(np.intersect1d(a, b)) == len(a) and i == j for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_long_near_copies_stay_within_memory(spark):
    """300 near copies of 20,000 words: no task's block pair holds more than two blocks' bytes, whatever the bucket."""
    base = [f"w{i}" for i in range(20000)]
    docs = [(k, " ".join([*base[: 60 * k], f"edit{k}", *base[60 * k + 1 :]])) for k in range(300)]
    got = neardup.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()
    assert {tuple(r[1:]) for r in got} == {(0, 299)}


def test_chain_of_edges(spark):
    edges = spark.createDataFrame([(f"n{i:03}".encode(), f"n{i + 1:03}".encode()) for i in range(40)] + [(b"x", b"x"), (b"y", b"z")], "a binary, b binary")
    got = {bytes(r["a"]): bytes(r["root"]) for r in neardup.components(edges).collect()}
    assert {got[f"n{i:03}".encode()] for i in range(1, 41)} == {b"n000"} and got[b"z"] == b"y"
