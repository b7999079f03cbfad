"""Centroid clustering by delta Lloyd rounds on integers.

Vectors are written once in blocks, in a table bucketed by block; each round writes one small table of owners in the
same buckets, so vectors and owners meet without a shuffle. A round compares a vector with the centroids that moved,
and with the others only if its own centroid moved away from it. What a round sends on are signed transfers: a vector
that changes hands is added to the sums of its new centroid and taken from those of the old one. The global sums and
the centroids (k rows of dim integers) live in the driver; everything that grows with the input lies in tables of the
shared folder. A round in which no vector moves ends the iteration, as all later ones would be the same.

All values are integers, floor(scale * x); sums are exact. Where numbers are too large for 64-bit arithmetic a block is
worked off with Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import let_go, new_path, written

DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Vectors of a block.
BLOCK = 1024
#: Integers below this bound keep squared distances of 64 components within 64 bits.
SAFE = 1 << 27
#: Transfers are sent on in digits of so many bits.
DIGIT = 60
#: Buckets of a table at most.
MOST_BUCKETS = 20_000

_TRANSFERS = "array<struct<c: int, p: int, i: int, v: bigint>>"


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers, or Python's where these do not suffice. scale is a power of two."""
    if not x.size or np.abs(x).max() < SAFE / scale:
        return np.floor(x * scale).astype(np.int64)
    whole = lambda v: int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale))
    return np.array([[whole(v) for v in row] for row in x.tolist()], object)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centroid."""
    if v.dtype != centroids.dtype:
        v, centroids = v.astype(object), centroids.astype(object)
    d = v[:, None, :] - centroids[None, :, :]
    return (d * d).sum(axis=2)


def _own(v: np.ndarray, centroids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    if v.dtype != centroids.dtype:
        v, centroids = v.astype(object), centroids.astype(object)
    d = v - centroids[owner]
    return (d * d).sum(axis=1)


def _best(v: np.ndarray, centroids: np.ndarray, among: np.ndarray, owner: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The nearest of the present owner (at distance own) and some centroids; ties go to the smaller number."""
    if not len(among) or not len(v):
        return owner
    d = distances(v, centroids[among])
    at = d.argmin(axis=1)
    least, number = d[np.arange(len(v)), at], among[at]
    return np.where((least < own) | ((least == own) & (number < owner)), number, owner)


def reassigned(v: np.ndarray, owner: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Owners under new centroids, from the owners under old ones.

    No centroid that stayed was nearer than the owner, so it can only win now if the owner moved away.
    """
    changed = np.flatnonzero((old != new).any(axis=1))
    own = _own(v, new, owner)
    moved = np.isin(owner, changed)
    away = np.zeros(len(v), bool)
    away[moved] = own[moved] > _own(v[moved], old, owner[moved])
    out = owner.copy()
    out[~away] = _best(v[~away], new, changed, owner[~away], own[~away])
    out[away] = _best(v[away], new, np.arange(len(new)), owner[away], own[away])
    return out


def transfers(v: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> list[dict]:
    """Signed sums of the vectors that changed hands, and their number (position dim), for each centroid."""
    out = []
    for c in range(k):
        came, went = after == c, np.zeros(len(after), bool) if before is None else before == c
        came, went = came & ~went, went & ~came
        if not (came.any() or went.any()):
            continue
        sums = [*(v[came].sum(axis=0) - v[went].sum(axis=0)).tolist(), int(came.sum()) - int(went.sum())]
        for p, x in enumerate(sums):
            sign, x, i = (-1 if x < 0 else 1), abs(x), 0
            while x:
                out.append({"c": c, "p": p, "i": i, "v": sign * (x & ((1 << DIGIT) - 1))})
                x, i = x >> DIGIT, i + 1
    return out


def _pack(x: np.ndarray) -> tuple[bytes, bool]:
    """Components as 32-bit numbers where these are exact, else as 64-bit ones."""
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    short = bool((small == x).all())
    return (small if short else x.astype("<f8")).tobytes(), short


def _unpack(raw: bytes, short: bool, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if short else "<f8").reshape(n, -1).astype(np.float64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, x) rows -> (block, ids, short, raw); the number of a block holds its task and its place there."""
    from pyspark import TaskContext

    let_go()
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        for k in range(0, b.num_rows, BLOCK):
            part = b.slice(k, BLOCK)
            raw, short = _pack(part.column(1).flatten().to_numpy(zero_copy_only=False))
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([short]), pa.array([raw], pa.binary())], ["block", "ids", "short", "raw"])
            number += 1


def _kept(vectors: DataFrame, vec: str, embedding: str, dim: int) -> DataFrame:
    x = F.col(f"`{embedding}`").cast("array<double>")
    whole = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(f"`{vec}`").alias("id"), x.alias("x")).filter(whole)


class _Buckets:
    """Tables of the shared folder in n buckets by block, so that joins on block need no shuffle."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.made = spark, n, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        table = "lodestar_" + path.rsplit("/", 1)[1].replace("-", "_")
        df.write.format("parquet").option("path", path).bucketBy(self.n, "block").sortBy("block").saveAsTable(table)
        self.made.append(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for table in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def _round(k: int, dim: int, scale: int, old: np.ndarray | None, new: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                v = integers(_unpack(r["raw"], r["short"], r["n"]), scale)
                before = None if old is None else np.frombuffer(r["owner"], "<i4")
                after = distances(v, new).argmin(axis=1) if old is None else reassigned(v, before, old, new)
                out.append({"block": r["block"], "owner": after.astype("<i4").tobytes(), "moved": int((before != after).sum()) if before is not None else r["n"], "transfers": transfers(v, before, after, k)})
            yield pa.RecordBatch.from_pylist(out, schema=_ROUND)

    return run


_ROUND = pa.schema([("block", pa.int64()), ("owner", pa.binary()), ("moved", pa.int64()), ("transfers", pa.list_(pa.struct([("c", pa.int32()), ("p", pa.int32()), ("i", pa.int32()), ("v", pa.int64())])))])


def _final(centroids: np.ndarray, scale: int):
    """(id, cluster, distance) for each vector; distance is null where it is over 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1)
                n = r.column("n")[0].as_py()
                v = integers(_unpack(r.column("raw")[0].as_py(), r.column("short")[0].as_py(), n), scale)
                owner = np.frombuffer(r.column("owner")[0].as_py(), "<i4")
                d = [x if x < 1 << 63 else None for x in _own(v, centroids, owner).tolist()]
                yield pa.RecordBatch.from_arrays([r.column("ids").flatten(), pa.array(owner), pa.array(d, pa.int64())], ["id", "cluster", "distance"])

    return run


def _start(kept: DataFrame, k: int, seed: str, scale: int) -> np.ndarray:
    """The k vectors whose hashed ids come first; null ids come last, equal ids by their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.select(h.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return integers(np.array([r["x"] for r in first], np.float64), scale)


def _shrunk(c: list[list[int]]) -> np.ndarray:
    """Centroids as 64-bit integers if they are small enough."""
    return np.array(c, np.int64) if all(abs(x) < SAFE for row in c for x in row) else np.array(c, object)


def cluster(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """((vec, cluster, distance) per kept vector, the final centroids in order of their numbers).

    Vectors of another length, or with a null or non-finite component, are left out. Fewer than k vectors give as many
    centroids; none give no rows. Repeated rows and repeated ids are vectors of their own; ids may be null. A distance
    over 64 bits is null. scale has to be a power of two, which keeps the products exact.
    """
    spark = vectors.sparkSession
    kept = _kept(vectors, vec, embedding, dim)
    kind = kept.schema["id"].dataType
    now = _start(kept, k, seed, scale)
    if not len(now):
        return kept.limit(0).select(F.col("id").alias(vec), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("short", T.BooleanType()), T.StructField("raw", T.BinaryType())])
    packed = written(kept.mapInArrow(_blocks, schema), "packed")
    tables = _Buckets(spark, max(1, min(packed.rdd.getNumPartitions(), MOST_BUCKETS)))
    blocks = tables.write(packed.repartition(tables.n, "block"), "vectors").withColumn("n", F.size("ids"))
    k = len(now)
    sums = [[0] * (dim + 1) for _ in range(k)]
    old = owners = None
    for _ in range(rounds + 1):
        rows = blocks.select("block", "short", "raw", "n")
        if old is not None and (old == now).all():
            break
        if old is not None:
            rows = rows.join(owners.select("block", "owner"), "block")
        owners = tables.write(rows.mapInArrow(_round(k, dim, scale, old, now), f"block bigint, owner binary, moved bigint, transfers {_TRANSFERS}"), "owners")
        sent = owners.select(F.explode("transfers").alias("t")).groupBy("t.c", "t.p", "t.i").agg(F.sum(F.col("t.v").cast("decimal(38,0)")).alias("v"))
        for r in sent.collect():  # k * (dim + 1) sums in a few digits
            sums[r["c"]][r["p"]] += int(r["v"]) << (DIGIT * r["i"])
        old, now = now, _shrunk([[x // s[dim] for x in s[:dim]] if s[dim] else c for s, c in zip(sums, now.tolist(), strict=True)])
    # old holds the centroids of the last assignment
    out = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    placed = written(blocks.join(owners.select("block", "owner"), "block").mapInArrow(_final(old, scale), out), "placed")
    tables.drop()
    return placed.withColumnRenamed("id", vec), old.tolist()


def _long(total: Column) -> Column:
    return F.when(total < (1 << 63), total).cast("long")


def with_inertia(placed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """placed with the distances summed over its cluster and over all, and the digest of its centroid.

    A sum over 64 bits, or with a null distance in it, is null.
    """
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: r for r in placed.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), total).alias("s")).collect()}  # one row a centroid
    parts = [sums[c]["s"] for c in sums]
    every = None if None in parts else int(sum(parts))
    rows = [(c, *(None if s is None or s >= 1 << 63 else int(s) for s in (sums[c]["s"], every)), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sums]
    table = placed.sparkSession.createDataFrame(rows, "c int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(table), F.col("cluster") == F.col("c")).drop("c")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return with_inertia(placed, centroids)


def _sql() -> str:
    """The same by SQL: plain Lloyd rounds, one after the other."""
    out = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        f" WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {DIM})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h LIMIT {K}))",
    ]
    dist = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.x, c.c, CAST({dist} AS BIGINT) AS d FROM v CROSS JOIN c{r} c) GROUP BY vec_id)")
        if r < ROUNDS:
            out.append(f"s{r} AS MATERIALIZED (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS x, unnest(range({DIM})) AS p FROM a{r}) GROUP BY c, p)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS x FROM s{r} GROUP BY c) m ON m.c = c.c)")
    last = f"a{ROUNDS}"
    return (
        f"WITH {', '.join(out)} SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM {last} a JOIN c{ROUNDS} c ON c.c = a.c"
    )


SQL = _sql()
