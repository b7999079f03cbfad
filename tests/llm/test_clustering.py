"""Delta Lloyd against plain Lloyd rounds on Python's integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lodestar.llm import clustering


def brute(rows, k=8, rounds=10, dim=64, scale=1024):
    """(id, cluster, distance) rows and centroids; rows are (id, vector)."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    raw = {id(x): x for x in kept}
    order = sorted(raw.values(), key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [r[1] for r in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == n]
            if mine:
                cents[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v in kept:
        d, n = nearest(v)
        out.append((i, n, d if d < 1 << 63 else None))
    return sorted(out, key=str), cents


def result(spark, rows, ddl="vec_id long, embedding array<float>, id long, owner string, block int", **kw):
    df = spark.createDataFrame([(*r, 7, "clash", 1) for r in rows], ddl).repartition(3)
    placed, cents = clustering.cluster(df, **kw)
    return sorted((tuple(r) for r in placed.collect()), key=str), cents, placed


@pytest.mark.parametrize("seed", range(2))
def test_random_vectors(spark, seed):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(64)] for _ in range(11)]
    rows = [(i * 7, [float(np.float32(m + r.gauss(0, 0.6))) for m in r.choice(middles)]) for i in range(400)]
    got, cents, placed = result(spark, rows)
    assert (got, cents) == brute(rows)
    for row in clustering.with_inertia(placed, cents).collect():
        mine = [x[2] for x in got if x[1] == row["cluster"]]
        assert row["cluster_inertia"] == sum(mine) and row["inertia"] == sum(x[2] for x in got)
        assert row["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[row["cluster"]])).encode()).hexdigest()


def test_left_out_rows_repeats_ties_and_null_ids(spark):
    r = random.Random(9)
    v = lambda: [float(r.randint(-2, 2)) for _ in range(64)]
    one = v()
    rows = [(1, None), (2, []), (3, v()[:63]), (4, [*v(), 0.0]), (5, [*v()[:63], None]), (6, [*v()[:63], float("nan")]), (7, [float("-inf"), *v()[:63]]), (None, v()), (None, one)]
    rows += [(8, one)] * 150 + [(9, v()), (9, v())] + [(k, v()) for k in range(20, 90)]
    got, cents, _ = result(spark, rows)
    assert (got, cents) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = [(k, [0.0] * 63 + [float(k % 2)]) for k in range(5)]
    got, cents, placed = result(spark, rows)
    assert (got, cents) == brute(rows) and len(cents) == 5
    got, cents, placed = result(spark, [(1, None)])
    assert got == [] and cents == [] and clustering.with_inertia(placed, cents).count() == 0


def test_numbers_beyond_64_bits(spark):
    r = random.Random(4)
    rows = [(k, [float(np.float32(r.choice([1e-40, 1.5, 3e38, -3.3e38, 2.0**40, 131071.9]) * r.random())) for _ in range(64)]) for k in range(40)]
    got, cents, placed = result(spark, rows)
    assert (got, cents) == brute(rows)
    assert {x["inertia"] for x in clustering.with_inertia(placed, cents).collect()} == {None}
    rows = [(k, [1.7e308 * r.random() for _ in range(3)]) for k in range(12)]
    got, cents, _ = result(spark, rows, "vec_id long, embedding array<double>, id long, owner string, block int", dim=3, k=2)
    assert (got, cents) == brute(rows, k=2, dim=3)


def test_only_changed_centroids_are_compared():
    r = np.random.default_rng(1)
    v, old = r.integers(-50, 50, (300, 4)), r.integers(-50, 50, (6, 4))
    owner = clustering.distances(v, old).argmin(axis=1)
    for changed in ([], [2], [0, 5], range(6)):
        new = old.copy()
        for c in changed:
            new[c] += r.integers(-20, 20, 4)
        assert (clustering.reassigned(v, owner, old, new) == clustering.distances(v, new).argmin(axis=1)).all()
