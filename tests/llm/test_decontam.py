"""Decontamination against trying every window of every document."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import decontam


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = (t or "").split()
        for i, it in items:
            iw = (it or "").split()
            if not iw or not w:
                continue
            a, best = collections.Counter(shingles(iw)), 0
            for p in range(max(1, len(w) - len(iw) + 1)):
                b = collections.Counter(shingles(w[p : p + len(iw)]))
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.8 - 1e-9:
                out.add((d, i, round(best, 6)))
    return out


def found(df):
    return {(r[0], r[1], r[3]) for r in df.collect()}


def test_small(spark, monkeypatch):
    r = random.Random(3)
    items = [(i, " ".join(f"w{r.randint(0, 50)}" for _ in range(r.choice([2, 4, 5, 8, 20, 40])))) for i in range(25)] + [(50, None), (51, ""), (52, "a b c d e " * 3), (53, "a b c d e " * 3)]
    docs = []
    for k in range(150):
        w, iw = [f"v{r.randint(0, 80)}" for _ in range(r.randint(0, 60))], (r.choice(items)[1] or "x").split()
        for _ in range(r.choice([0, 0, 1, 2])):
            if len(iw) > 8:
                iw[r.randrange(len(iw))] = "q"
        p = r.randint(0, len(w))
        docs.append((k, " ".join(w[:p] + iw + w[p:])))
    docs += [(900, None), (901, ""), (902, items[3][1]), (903, "a b c d e " * 9), (904, " ".join(f"v{i}" for i in range(30000)))]
    d, b = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert found(decontam.contaminated(d, b)) == want
    monkeypatch.setattr(decontam, "INDEX_CHARS", 300)  # several indexes
    assert found(decontam.contaminated(d, b)) == want
    clean = decontam.drop_contaminated(d, b)
    assert clean.columns == d.columns and {r[0] for r in clean.collect()} == {x[0] for x in docs} - {x[0] for x in want}


def test_block_lookup_finds_all_within_the_radius():
    r = np.random.default_rng(1)
    for n in (5, 3000):  # compared as they are, and probed
        prints = r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        asked = prints[r.integers(0, n, 200)]
        for k, flips in enumerate(r.integers(0, decontam.RADIUS + 4, 200)):
            for bit in r.choice(64, flips, replace=False):
                asked[k] ^= np.uint64(1) << np.uint64(bit)
        tables = decontam.index_of([(i, f"a b c d e f {i}") for i in range(n)]) | {"prints": prints}
        want = np.argwhere(np.bitwise_count(asked[:, None] ^ prints[None, :]) <= decontam.RADIUS)
        assert decontam.Search(tables).near(asked, 7).tolist() == want.tolist()


def test_recall_of_the_fingerprints_at_the_threshold():
    """Windows of similarity just over 0.8 lie within the radius."""
    r, met, n = random.Random(9), 0, 1500
    for _ in range(n):
        words = [f"w{r.getrandbits(40)}" for _ in range(r.choice([20, 49, 120]))]
        edited = list(words)
        least = int((len(words) - 4) * 0.2 / 1.8)  # shingles that may differ on each side
        for k in range(least // 5):
            edited[(k + 1) * len(words) // (least // 5 + 1)] = "z"
        s, t = (decontam.shingles(decontam.word_hashes(" ".join(w).encode())) for w in (words, edited))
        a, b = (decontam.fingerprints(decontam.bits_of(x), np.array([0]), len(x)) for x in (s, t))
        met += int(np.bitwise_count(a ^ b)[0] <= decontam.RADIUS)
    print("recall of the fingerprints", met / n)
    assert met >= 0.998 * n


def test_query_on_the_table(spark, sf):
    docs, items = ([tuple(x) for x in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert found(decontam.op4_decontamination(spark, sf)) == brute([d for d in docs if len(d[1] or "") < 3000], items) | found(decontam.op4_decontamination(spark, sf).filter(F.col("doc_id").isin([d for d, t in docs if len(t or "") >= 3000])))


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.contaminated(d, b).count() == 0 and decontam.contaminated(one, b).count() == 0 and decontam.drop_contaminated(one, b).count() == 1


def test_item_ids_may_be_null_or_text(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a b c {item} d e"), (2, "clean text of some words here")], "doc_id long, text string")
    for ids, kind in (((None, 5), "long"), (("hellaswag-1", None), "string")):
        items = spark.createDataFrame([(ids[0], item), (ids[1], item), (None, None)], f"item_id {kind}, text string")
        got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}
        assert got == {(1, ids[0]), (1, ids[1])}
        assert [r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()] == [2]
