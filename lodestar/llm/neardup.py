"""N-gram Jaccard join by a MinHash LSH forest.

Each text has one label per tree, a run of min-hashes; the sorted labels of a tree form a prefix trie whose nodes
are kept as tables (prefix, texts below it). A text starts at its deepest prefixes and shortens them, tree by
tree, until a partner at the threshold shares one of them with the target probability. It shortens adaptively:
prefixes whose wider node is small come first, so prefixes that very many texts share stay long while others
suffice. A node that some text chose is open to all texts below it; texts under one open node meet in a bucket,
and every pair there is verified on its exact shingle sets, in blocks bounded by bytes, at the first bucket that
holds both; texts whose pairs in a bucket are all settled earlier are not sent to it. Tasks return link counts and the least text of each component, never the pairs; classes are the
connected components.

Equal texts are one text with a count. Buckets with the same members are one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import let_go, pieces, written
from lodestar.llm.shingles import mix, shingles, word_hashes

K, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES = 24
#: A prefix is shortened first where at most so many texts share the shorter one.
NODE = 64
#: A block of a bucket: at most so many texts and about so many bytes of shingles.
BLOCK_TEXTS, BLOCK_BYTES = 512, 4 << 20
#: Bytes of a shingle's hash that travel to the verification.
BYTES = 6
#: Up to this many texts in buckets their digests (16 bytes each) are broadcast to thin out the texts before the join.
BROADCAST_TEXTS = 500_000
#: Earlier buckets by which the members of a bucket are classed.
HUBS = 8
#: Patterns of owners counted at once.
COLUMNS = 2048


def gain(threshold: float, depth: int) -> float:
    """What a tree adds to -log of the probability that a pair at the threshold is missed, at a prefix length."""
    return -math.log1p(-(threshold**depth))


def depths(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """Prefix lengths of the forest: the middle one reaches the target in all trees together, others lie beside it."""
    need = -math.log1p(-recall)
    reach = [d for d in range(1, 17) if TREES * gain(threshold, d) >= need]
    if not reach:
        raise ValueError(f"{TREES} trees can't reach recall {recall} at similarity {threshold}")
    low = max(1, reach[-1] - 1)
    return low, low + 1, low + 2


def choose(wide5: np.ndarray, wide4: np.ndarray, threshold: float = THRESHOLD, recall: float = RECALL) -> np.ndarray:
    """How far each text (row) shortens its prefix in each tree (column): 0, 1 or 2 values.

    wide5 and wide4 say whether more than NODE texts share the prefix shortened by one and by two values. Steps
    that stay in small nodes come first, then the others, in tree order; a text stops at the target. The order
    does not depend on where a single partner stands, so the target holds for each of them.
    """
    low, mid, deep = depths(threshold, recall)
    one, two = gain(threshold, mid) - gain(threshold, deep), gain(threshold, low) - gain(threshold, mid)
    wide4 = wide4 | wide5
    steps = np.concatenate((np.where(wide5, 0, one), np.where(wide4, 0, two), np.where(wide5, one, 0), np.where(wide4, two, 0)), axis=1)
    before = np.cumsum(steps, axis=1) - steps
    taken = ((before < -math.log1p(-recall) - TREES * gain(threshold, deep)) & (steps > 0)).reshape(len(steps), 4, -1)
    return (taken[:, 0] | taken[:, 2]).astype(np.int8) + (taken[:, 1] | taken[:, 3])


def _salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def labels(s: np.ndarray, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray]:
    """For each tree the shortest prefix (tree number and first values, hashed) and 16 bits of each of the two next values."""
    low, _, deep = depths(threshold, recall)
    salts = _salts(TREES * deep)
    mins = np.full(len(salts), np.uint64((1 << 64) - 1))
    for k in range(0, len(s), 256):
        np.minimum(mins, (s[k : k + 256, None] * salts[None, :]).min(axis=0), out=mins)
    mins = mins.reshape(TREES, deep)
    key = np.arange(1, TREES + 1, dtype=np.uint64)
    for k in range(low):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mins[:, k])
    tail = mix(mins[:, low:] + np.uint64(1)) >> np.uint64(48)
    return key.view(np.int64), (tail[:, 0] << np.uint64(16) | tail[:, 1]).astype(np.int64)


def shingle_set(text: str | None, k: int = K) -> np.ndarray:
    return np.unique(shingles(word_hashes((text or "").encode()), k))


def _signed(batches: Iterator[pa.RecordBatch], k: int, threshold: float, recall: float) -> Iterator[pa.RecordBatch]:
    let_go()
    none = np.zeros(0, np.int64)
    for b in pieces(batches, 2):
        keys, tails, size = [], [], []
        for text in b.column(2).to_pylist():
            s = shingle_set(text, k)
            key, tail = labels(s, threshold, recall) if len(s) else (none, none)
            keys.append(key)
            tails.append(tail)
            size.append(len(s))
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (keys, tails)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), *lists], ["d", "t", "size", "keys", "tails"])


def _shortened(batches: Iterator[pa.RecordBatch], threshold: float, recall: float) -> Iterator[pa.RecordBatch]:
    """A row for each text and tree in which it is not alone: by how much its prefix is shortened there."""
    for b in batches:
        nodes = b.column(1)
        tree, key, tail, n4, n5 = (nodes.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("tree", "key", "tail", "n4", "n5"))
        row = np.repeat(np.arange(b.num_rows), np.diff(nodes.offsets.to_numpy()))
        wide5, wide4 = np.zeros((b.num_rows, TREES), bool), np.zeros((b.num_rows, TREES), bool)
        wide5[row, tree], wide4[row, tree] = n5 > NODE, n4 > NODE
        cut = choose(wide5, wide4, threshold, recall)[row, tree]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(key), pa.array(tail), pa.array(cut.astype(np.int32))], ["t", "key", "tail", "cut"])


def forest(texts: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(t, b) for each text and open node above it; texts: t, keys, tails. Nodes with one text are left out."""
    in_trees = texts.select("t", F.posexplode(F.arrays_zip("keys", "tails")).alias("tree", "x")).select("t", "tree", F.col("x.keys").alias("key"), F.col("x.tails").alias("tail"))
    mid = F.shiftright("tail", 16).alias("mid")
    shared = in_trees.groupBy("key").agg(F.count("*").alias("n4")).filter("n4 > 1")
    trie = written(in_trees.join(shared, "key").withColumn("mid", mid), "trie")
    wider = trie.join(trie.groupBy("key", "mid").agg(F.count("*").alias("n5")), ["key", "mid"])
    by_text = wider.groupBy("t").agg(F.collect_list(F.struct("tree", "key", "tail", "n4", "n5")).alias("nodes"))
    chosen = written(by_text.mapInArrow(lambda it: _shortened(it, threshold, recall), "t binary, key long, tail long, cut int").withColumn("mid", mid), "prefixes")
    nodes = chosen.groupBy("key", "mid").agg(F.max("cut").alias("cut_mid"))
    tops = nodes.groupBy("key").agg(F.max("cut_mid").alias("cut_top")).filter("cut_top = 2")
    placed = chosen.join(nodes, ["key", "mid"]).join(tops, "key", "left")
    node = F.when(F.col("cut_top") == 2, F.xxhash64("key")).when(F.col("cut_mid") > 0, F.xxhash64("key", "mid")).otherwise(F.xxhash64("key", "mid", "tail"))
    return placed.select("t", node.alias("b"))


def asked(in_buckets: DataFrame) -> DataFrame:
    """(t, kept, asked) per text: its buckets, large ones first, and those in which it has to be compared, with their blocks.

    A pair is settled at the first bucket that holds both, so near copies that meet in most trees need only few of
    their buckets. The earlier buckets that most members of a bucket share are its hubs; members are classed by
    their hubs, and a member whose class has a hub in common with every other one is settled there already.
    """
    buckets = in_buckets.groupBy("b").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum(F.xxhash64("t").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("t", F.lit(1))).alias("y")).filter("n > 1")
    different = buckets.groupBy("n", "size", "x", "y").agg(F.min("b").alias("b")).select("b", (-F.col("n")).alias("o"))
    kept = in_buckets.join(different, "b").groupBy("t", "size").agg(F.sort_array(F.collect_list(F.struct("o", "b"))).alias("kept"))
    kept = written(kept.select("t", "size", F.col("kept.b").alias("kept")), "kept")
    each = kept.select("t", "size", F.posexplode("kept").alias("at", "b"), F.slice("kept", 1, HUBS).alias("first")).withColumn("first", F.slice("first", F.lit(1), F.col("at")))
    often = each.select("b", F.explode(F.slice("first", 1, HUBS // 2)).alias("e")).groupBy("b", "e").agg(F.count("*").alias("n"))
    most = often.withColumn("k", F.row_number().over(W.partitionBy("b").orderBy(F.desc("n"), "e"))).filter(F.col("k") <= HUBS)
    hubs = most.groupBy("b").agg(F.collect_list("e").alias("hubs"))
    bits = F.transform("hubs", lambda h, i: F.when(F.array_contains("first", h), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    classed = written(each.join(hubs, "b", "left").select("t", "size", "b", F.coalesce(F.aggregate(bits, F.lit(0), lambda x, y: x + y), F.lit(0)).alias("class")), "classes")
    classes = classed.groupBy("b", "class").agg(F.count("*").alias("n"))
    apart = F.exists("all", lambda x: (x["class"].bitwiseAND(F.col("class")) == 0) & ((x["class"] != F.col("class")) | (x["n"] > 1)))
    of_bucket = classes.groupBy("b").agg(F.collect_list(F.struct("class", "n")).alias("all")).select("*", F.explode("all.class").alias("class"))
    compared = classed.join(of_bucket.filter(apart).select("b", "class"), ["b", "class"])
    sums = compared.groupBy("b").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("size") * BYTES / BLOCK_BYTES)).alias("g")
    listed = compared.select("t", "b").join(sums.select("b", blocks), "b").groupBy("t").agg(F.collect_list(F.struct("b", "g")).alias("asked"))
    return kept.join(listed, "t").select("t", "kept", "asked")


def _members(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(bucket, block pair, whether of two blocks, block, text, copies, earlier buckets, shingles) for each bucket and block pair of a text."""
    names = ["bucket", "pair", "across", "block", "t", "c", "earlier", "set"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def rows(b):
        for r in b.to_pylist():
            s = np.ascontiguousarray(shingle_set(r["text"], k).view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes()
            for x in r["asked"]:
                bucket, g = x["b"], x["g"]
                earlier = r["kept"][: r["kept"].index(bucket)]
                own = (int.from_bytes(r["t"][:8], "little") ^ (bucket & 0xFFFFFFFF)) % g
                for j in range(g):
                    yield bucket, min(own, j) * g + max(own, j), own != j, own, r["t"], r["c"], earlier, s

    def batch(part):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part, strict=True), kinds, strict=True)], names)

    for b in pieces(batches, 3):
        part, size = [], 0
        for row in rows(b):
            part.append(row)
            size += len(row[-1])
            if size >= BLOCK_BYTES or len(part) >= 1024:
                yield batch(part)
                part, size = [], 0
        if part:
            yield batch(part)


def overlaps(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n owners share; an owner has a value once, and owners ascend.

    Values with the same owners are one column with a weight, so that near copies cost as many columns as they
    have differences; values of one owner cost none.
    """
    out = np.zeros((n, n), np.float32)
    if not len(values):
        return out
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    count = np.diff(np.append(first, len(v)))
    held = np.add.reduceat(mix(o.astype(np.uint64) + np.uint64(1)), first)
    many = np.flatnonzero(count > 1)
    if not len(many):
        return out
    _, one, weight = np.unique(mix(held[many]) + count[many].astype(np.uint64), return_index=True, return_counts=True)
    first, count = first[many[one]], count[many[one]]
    for k in range(0, len(first), COLUMNS):
        size = count[k : k + COLUMNS]
        starts = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(first[k : k + COLUMNS] - starts, size)
        m = np.zeros((n, len(size)), np.float32)
        m[o[at], np.repeat(np.arange(len(size)), size)] = 1
        out += (m * weight[k : k + COLUMNS].astype(np.float32)) @ m.T
    return out


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return out.reshape(-1).view(np.uint64)


def _verify(table: pa.Table, threshold: float) -> pa.Table:
    """Links of each text in one block pair of a bucket, and the least text of its component there."""
    table = table.combine_chunks().sort_by("t")
    n = table.num_rows
    t = table.column("t").to_pylist()
    sets = [_unpacked(x.as_buffer()) for x in table.column("set")]
    size = np.array([len(s) for s in sets], np.int64)
    common = overlaps(np.repeat(np.arange(n), size), np.concatenate(sets), n)
    del sets
    # a pair that shares an earlier bucket is settled there
    earlier = table.column("earlier").to_pylist()
    settled = overlaps(np.repeat(np.arange(n), [len(e) for e in earlier]), np.array([x for e in earlier for x in e], np.int64), n)
    num, near = round(threshold * 1000), np.zeros((n, n), bool)
    block = table.column("block").to_numpy() if table.column("across")[0].as_py() else None
    for i in range(n):
        both = common[i].astype(np.int64)
        near[i] = (both * (1000 + num) >= num * (size[i] + size)) & (settled[i] == 0)
        near[i, i] = False
        if block is not None:
            near[i] &= block != block[i]
    links = near @ table.column("c").to_numpy().astype(np.float64)
    least = np.arange(n)
    while True:
        now = np.array([min(least[i], least[near[i]].min(initial=n)) for i in range(n)])
        now = now[now]
        if (now == least).all():
            break
        least = now
    hit = np.flatnonzero(links)
    return pa.table([pa.array([t[i] for i in hit], pa.binary()), pa.array([t[i] for i in least[hit]], pa.binary()), pa.array(links[hit].astype(np.int64))], ["a", "b", "links"])


def components(edges: DataFrame) -> DataFrame:
    """(a, root): the least member of each node's component; edges (a, b). Large-star and small-star in turn."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")), F.lit(0))).first())
    seen = mark(now)
    while True:
        x = both(now)
        least = x.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = x.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = written(small, "edges")
        new = mark(now)
        if new == seen:
            return now.select("a", F.col("b").alias("root"))
        seen = new


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = K, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """((d, t) per row of docs, (t, rep, n_rep, class_id, n_links, kept) per different text).

    d is the row's id and t the digest of its text. rep is the least id with this text and n_rep how many rows have
    both. class_id is the least id of the class; n_links counts the other rows whose similarity is at or over the
    threshold; kept marks one text of each class. Texts of 1 to k-1 words have one shingle, the text itself. Null
    and empty texts and those without words link to nothing but equal texts (null is equal to empty). Null ids come
    last in a class. Repeated rows are copies of each other.
    """
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc}`").alias("d"), _digest(text).alias("t"), F.col(f"`{text}`").alias("text"))
    signed = written(rows.mapInArrow(lambda it: _signed(it, k, threshold, recall), f"d {kind}, t binary, size long, keys array<long>, tails array<long>"), "signatures")
    sketch = [F.first(c).alias(c) for c in ("size", "keys", "tails")]
    ids = signed.groupBy("t", "d").agg(F.count("*").alias("n"), *sketch)
    least = F.min(F.struct(F.col("d").isNull().alias("z"), "d", "n")).alias("least")
    texts = written(ids.groupBy("t").agg(least, F.sum("n").alias("c"), *sketch).select("t", F.col("least.d").alias("rep"), F.col("least.n").alias("n_rep"), "c", "size", "keys", "tails"), "texts")
    in_buckets = written(forest(texts, threshold, recall).join(texts.select("t", "size"), "t"), "buckets")
    members = written(asked(in_buckets).join(texts.select("t", "rep", "n_rep", "c"), "t").select(F.col("t").alias("t2"), "rep", "n_rep", "c", "kept", "asked"), "members")
    near = rows.join(F.broadcast(members.select(F.col("t2").alias("t"))), "t", "left_semi") if members.count() <= BROADCAST_TEXTS else rows
    with_text = near.join(members, (F.col("t") == F.col("t2")) & F.col("d").eqNullSafe(F.col("rep"))).select("t", "c", "kept", "text", "asked", "n_rep")
    with_text = with_text.filter("n_rep = 1").unionByName(with_text.filter("n_rep > 1").dropDuplicates(["t"]))  # repeated rows
    sets = with_text.mapInArrow(lambda it: _members(it, k), "bucket long, pair long, across boolean, block long, t binary, c long, earlier array<long>, set binary")
    linked = written(sets.groupBy("bucket", "pair").applyInArrow(lambda x: _verify(x, threshold), "a binary, b binary, links long"), "links")
    links = linked.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "t")
    roots = components(linked.select("a", "b")).withColumnRenamed("a", "t")
    placed = texts.select("t", "rep", "c", "n_rep").join(links, "t", "left").join(roots, "t", "left").withColumn("root", F.coalesce("root", "t"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("z"), "rep", "t")).alias("first"))
    table = placed.join(first, "root").select("t", "rep", "n_rep", F.col("first.rep").alias("class_id"), (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), (F.col("first.t") == F.col("t")).alias("kept"))
    return signed.select("d", "t"), table


def _digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


def jaccard_join(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, class_id, n_links) per row of docs; see classes."""
    rows, table = classes(docs, doc, text, k, threshold)
    return rows.join(table, "t").select(F.col("d").alias(doc), "class_id", "n_links")


def drop_near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class stays, one with the least id; all columns stay. Of equal rows one stays."""
    keep = classes(docs, doc, text)[1].filter("kept").select("t", "rep", (F.col("n_rep") > 1).alias("many"))
    # the caller's columns go under numbers, so none of their names can clash with one in here
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], _digest(text).alias("own"))
    kept = rows.join(keep, (F.col("own") == F.col("t")) & F.col(f"c{docs.columns.index(doc)}").eqNullSafe(F.col("rep")))
    one = kept.filter("not many").unionByName(kept.filter("many").dropDuplicates(["t"]))
    return one.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
