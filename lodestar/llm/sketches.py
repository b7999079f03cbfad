"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch has T coordinates and is filled in rounds: round i throws every shingle of a set into a bin by hash i, with
the value i + h in a bin that has none smaller; the first T rounds choose bins at random, round T + b puts everything
into bin b. A set stops as soon as all bins are filled, so a large one needs a single round and every set fills every
coordinate. Two sets agree in a coordinate with the probability of their Jaccard similarity, and the number of
agreements is concentrated as if coordinates were independent.

Texts that agree in a whole band meet. Components do not need every pair: first each text of a band is compared with
one text of it (a star), so a band of near copies costs as many comparisons as it has texts. Bands whose texts are
not all in one component then go to the exact block-wise verification, which settles every pair that is left. Links
are always confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import neardup
from lodestar.llm.common import let_go, pieces, written
from lodestar.llm.shingles import mix, shingles, word_hashes

K, THRESHOLD = 4, 0.8
#: Coordinates of a sketch: BANDS bands of ROWS. A pair at 0.8 shares a band with probability 0.999993.
BANDS, ROWS = 30, 5
T = BANDS * ROWS
#: Rounds of stars before the block-wise verification; each takes another text of a band as its middle.
STARS = 2
#: Bytes of text and number of texts that are compared with the middle of a star in one group.
GROUP_BYTES, GROUP_TEXTS = 4 << 20, 512

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 40) - 1)
# The letters whose case does not count.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def missed(similarity: float) -> float:
    """Probability that a pair shares no band."""
    return (1 - similarity**ROWS) ** BANDS


def shingle_set(text: str | None, k: int = K) -> np.ndarray:
    return np.unique(shingles(word_hashes((text or "").encode()), k))


def _round_hashes(s: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    return mix(s[None, :] ^ mix((rounds.astype(np.uint64) + np.uint64(1)) * _GOLDEN)[:, None])


def sketch(s: np.ndarray, t: int = T) -> np.ndarray:
    """The t coordinates of a set of hashes: round number and 40 bits of the least hash in it; an empty set has none.

    Several rounds are computed at once; rounds after the one that fills the last bin change nothing, as values of an
    earlier round are smaller.
    """
    if not len(s):
        return np.zeros(0, np.uint64)
    unfilled = np.uint64((1 << 64) - 1)
    out = np.full(t, unfilled)
    step, i = max(1, 2048 // len(s)), 0
    while i < t and (out == unfilled).any():
        rounds = np.arange(i, min(t, i + step))
        h = _round_hashes(s, rounds)
        bins = ((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)
        values = (rounds.astype(np.uint64) << np.uint64(40))[:, None] | (h & _LOW)
        np.minimum.at(out, bins.ravel().astype(np.int64), values.ravel())
        i += step
    left = np.flatnonzero(out == unfilled)
    for k in range(0, len(left), step):
        rounds = t + left[k : k + step]
        out[left[k : k + step]] = (rounds.astype(np.uint64) << np.uint64(40)) | (_round_hashes(s, rounds) & _LOW).min(axis=1)
    return out


def bands(s: np.ndarray) -> np.ndarray:
    """A hash for each band of a set's sketch."""
    x = sketch(s)
    if not len(x):
        return np.zeros(0, np.int64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in x.reshape(BANDS, ROWS).T:
        key = mix(key * _GOLDEN + column)
    return key.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    let_go()
    for b in pieces(batches, 2):
        size, keys = [], []
        for text in b.column(2).to_pylist():
            s = shingle_set(text, k)
            size.append(len(s))
            keys.append(bands(s))
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys)))], ["d", "t", "size", "keys"])


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the similarity of two sets is at or over the threshold, in integers."""
    both, num = len(np.intersect1d(a, b, assume_unique=True)), round(threshold * 1000)
    return both * (1000 + num) >= num * (len(a) + len(b))


def _star(k: int, threshold: float):
    """Texts of a group that link to its middle (the row without `middle`): (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        hit, middle, names = [], None, table.column("t").to_pylist()
        is_middle = table.column("middle").to_pylist()
        texts = table.column("text")
        for i, m in enumerate(is_middle):
            if m:
                middle = (names[i], shingle_set(texts[i].as_py(), k))
        for i, m in enumerate(is_middle):
            if not m and middle and alike(shingle_set(texts[i].as_py(), k), middle[1], threshold):
                hit.append(names[i])
        return pa.table([pa.array(hit, pa.binary()), pa.array([middle[0]] * len(hit) if hit else [], pa.binary())], ["a", "b"])

    return run


def _stars(placed: DataFrame, texts: DataFrame, k: int, threshold: float, turn: int) -> DataFrame:
    """(a, b) links between each text and one other text of each of its bands, another one each turn.

    placed: t, b, root. Middles are the least in an order of all texts that differs by turn, so bands with about the
    same texts mostly have the same one. Texts that are in the middle's component already are not compared with it.
    """
    rank = F.xxhash64("t", F.lit(turn))
    middles = placed.groupBy("b").agg(F.min(F.struct(rank.alias("x"), "t", "root")).alias("m"))
    pairs = placed.join(middles, "b").filter(F.col("root") != F.col("m.root")).select("t", F.col("m.t").alias("m")).distinct()
    pairs = written(pairs.join(texts.select("t", F.col("bytes")), "t"), "star-pairs")
    parts = pairs.groupBy("m").agg(F.greatest(F.ceil(F.sum("bytes") / GROUP_BYTES), F.ceil(F.count("*") / GROUP_TEXTS)).alias("n"))
    parts = written(parts, "star-parts")
    rest = pairs.join(parts, "m").select("t", "m", F.pmod(F.xxhash64("t"), F.col("n")).alias("part")).join(texts.select("t", "text"), "t").withColumn("middle", F.lit(False))
    own = parts.select(F.col("m").alias("t"), "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part")).join(texts.select("t", "text"), "t").withColumn("middle", F.lit(True))
    return rest.unionByName(own).groupBy("m", "part").applyInArrow(_star(k, threshold), "a binary, b binary")


def _rooted(texts: DataFrame, links: DataFrame | None) -> DataFrame:
    """(t, root) of each text in some band under the links found so far."""
    if links is None:
        return texts.select("t", F.col("t").alias("root"))
    roots = neardup.components(links).withColumnRenamed("a", "__a").withColumnRenamed("root", "__root")
    return texts.select("t").join(roots, F.col("t") == F.col("__a"), "left").select("t", F.coalesce("__root", "t").alias("root"))


def _mixed(in_bands: DataFrame, roots: DataFrame) -> DataFrame:
    """(t, b, size, root) in bands whose texts are not all in one component."""
    rows = in_bands.join(roots, "t")
    open_ = rows.groupBy("b").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("b")
    return rows.join(open_, "b", "left_semi")


def links(texts: DataFrame, keyed: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b) links that give the components of all pairs at or over the threshold.

    texts: t, text, bytes for each row; keyed: t, size, keys for each different text.
    """
    in_bands = keyed.select("t", "size", F.explode("keys").alias("b"))
    met = in_bands.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("t").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("t", F.lit(1))).alias("y")).filter("n > 1")
    different = met.groupBy("n", "x", "y").agg(F.min("b").alias("b")).select("b")  # bands of the same texts are one
    in_bands = written(in_bands.join(different, "b"), "bands")
    there = written(in_bands.select("t").distinct(), "banded")
    few = there.count() <= neardup.BROADCAST_TEXTS
    near = (texts.join(F.broadcast(there), "t", "left_semi") if few else texts).dropDuplicates(["t"])
    near = written(near if few else near.join(there, "t", "left_semi"), "near")
    found = None
    for turn in range(STARS):
        placed = written(_mixed(in_bands, _rooted(there, found)), "open")
        more = written(_stars(placed, near, k, threshold, turn), "stars")
        found = more if found is None else found.unionByName(more)
    # what is left goes to the exact verification of every pair in a band
    rest = written(_mixed(in_bands, _rooted(there, found)).select("t", "b", "size"), "rest")
    asked = neardup.asked(rest)
    rows = near.join(asked, "t").select("t", F.lit(1).cast("long").alias("c"), "kept", "text", "asked")
    sets = rows.mapInArrow(lambda it: neardup._members(it, k), "bucket long, pair long, across boolean, block long, t binary, c long, earlier array<long>, set binary")
    pairs = sets.groupBy("bucket", "pair").applyInArrow(lambda x: neardup._verify(x, threshold), "a binary, b binary, links long")
    return found.unionByName(written(pairs.select("a", "b"), "pairs"))


def near_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, n_shingles, component_id, kept) for each row of docs.

    A-Z count as a-z; a set holds the distinct k-word shingles, or the whole word sequence of a shorter text. Rows at
    or over the threshold are linked, component_id is the least id that links reach. Null and empty texts and those
    without words have no shingles and link with nothing, not even each other. Null ids come last: only a component of
    null ids alone has a null component_id. kept is whether doc is component_id, so of rows that repeat the least id
    all are kept. Any type of id that can be ordered will do.
    """
    kind = docs.schema[doc].dataType.simpleString()
    lower = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(f"`{doc}`").alias("d"), F.unhex(F.md5(lower.cast("binary"))).alias("t"), lower.alias("text"))
    signed = written(rows.mapInArrow(lambda it: _sketched(it, k), f"d {kind}, t binary, size long, keys array<long>"), "sketches")
    # null ids sort behind all others in a min over (is null, id)
    least = F.min(F.struct(F.col("d").isNull().alias("z"), "d"))
    distinct = written(signed.filter("size > 0").groupBy("t").agg(least.alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys")), "texts")
    whole = rows.select("t", "text", F.octet_length("text").cast("long").alias("bytes"))
    found = links(whole, distinct.select("t", "size", "keys"), k, threshold)
    roots = neardup.components(found).withColumnRenamed("a", "__a")
    rooted = distinct.select("t", "least").join(roots, F.col("t") == F.col("__a"), "left").withColumn("root", F.coalesce("root", "t"))
    first = rooted.groupBy("root").agg(F.min("least").alias("first")).withColumnRenamed("root", "__root")
    placed = rooted.join(first, F.col("root") == F.col("__root")).select(F.col("t").alias("__t"), F.col("first.d").alias("c"))
    out = signed.filter("size > 0").select("d", "t", "size").join(placed, F.col("t") == F.col("__t")).select("d", "size", "c")
    out = out.unionByName(signed.filter("size = 0").select("d", "size", F.col("d").alias("c")))
    return out.select(F.col("d").alias(doc), F.col("size").alias("n_shingles"), F.col("c").alias("component_id"), F.col("d").eqNullSafe(F.col("c")).alias("kept"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = " ".join(rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {K} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' ')) END) AS s FROM w),
n AS MATERIALIZED (SELECT r, doc_id, len(s) AS n FROM s),
x AS MATERIALIZED (SELECT r, hash(unnest(s)) AS h FROM s),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS both_n FROM x a JOIN x b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * both_n >= 80 * (p.n + q.n - both_n)),
way AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, a AS b FROM way UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a),
least AS (SELECT reach.a, min(n.doc_id) AS c FROM reach JOIN n ON n.r = reach.b GROUP BY reach.a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least.c, n.doc_id) AS component_id, n.doc_id = coalesce(least.c, n.doc_id) AS kept FROM n LEFT JOIN least ON least.a = n.r
""".split())
