"""Merkle manifest of a dataset, with an authentication path for each row by Merkle traversal scheduling.

Rows are leaves; each source is a 16-ary tree of its leaves by id, and the subroots of the sources form one more tree of
the same kind. A tree is worked off in aligned blocks of 256 nodes, so no source has to fit into a task: a block's root
comes from one treehash stack, block roots are the nodes of the next storey, and so on until one node of each tree is
left. Paths go the other way. A block's traversal keeps, for each level, the run of siblings that the current leaf
needs and a treehash stack that builds the next run ahead of it; each leaf advances every stack by one leaf, so a
run is ready when its first leaf comes, and the state is a few runs a level. The path above a block is the same for
all of its leaves; it is computed once, storey by storey, and appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import written

ARITY = 16
#: Levels of a block; a block has ARITY ** STOREY nodes.
STOREY = 2
BLOCK = ARITY**STOREY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tables of at most so many rows are broadcast.
BROADCAST_ROWS = 100_000

_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_PATH = "array<struct<left: string, right: string>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Treehash:
    """A stack of unfinished runs: push takes nodes of level 0; full runs become one node a level higher.

    out(level, node) is told of every node that is made, from left to right on each level.
    """

    def __init__(self, levels: int, out):
        self.runs: list[list[str]] = [[] for _ in range(levels)]
        self.out = out

    def push(self, node: str, level: int = 0) -> None:
        self.out(level, node)
        if level < len(self.runs):
            self.runs[level].append(node)
            if len(self.runs[level]) == ARITY:
                self._fold(level)

    def _fold(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self.push(digest(*run), level + 1)

    def flush(self) -> None:
        """The last runs are shorter; they are folded from the lowest level up."""
        for level, run in enumerate(self.runs):
            if run:
                self._fold(level)


def block_root(nodes: list[str], levels: int) -> str:
    top = []
    stack = Treehash(levels, lambda level, node: top.append(node) if level == levels else None)
    for node in nodes:
        stack.push(node)
    stack.flush()
    return top[0]


class _Ahead:
    """The run of a level that the current leaf stands under, and the stack that builds the run after it."""

    def __init__(self, level: int, nodes: list[str]):
        self.level, self.nodes, self.at = level, nodes, 0
        self.span = ARITY ** (level + 1)
        self._start()
        for _ in range(self.span):
            self.advance()
        self.swap()

    def _start(self) -> None:
        self.next: list[str] = []
        self.stack = Treehash(self.level, lambda level, node: self.next.append(node) if level == self.level else None)

    def advance(self) -> None:
        """One more leaf of the run after the current one, if the block goes on."""
        if self.at < len(self.nodes):
            self.stack.push(self.nodes[self.at])
            self.at += 1
            if self.at == len(self.nodes):
                self.stack.flush()

    def swap(self) -> None:
        self.run = self.next
        self._start()


def traverse(nodes: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each node in order its path in the block: what stands left and right of it in the run of each level."""
    ahead = [_Ahead(level, nodes) for level in range(levels)]
    for i in range(len(nodes)):
        path = []
        for a in ahead:
            if i and i % a.span == 0:
                a.swap()
            k = i // ARITY**a.level % ARITY
            path.append(("".join(a.run[:k]), "".join(a.run[k + 1 :])))
        for a in ahead:
            a.advance()
        yield path


def height(n: int) -> int:
    """Levels above n nodes until one is left, within a block; more nodes than a block holds fill all its levels."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return min(levels, STOREY)


def _roots(table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    root = block_root(table.column("node").to_pylist(), height(table.column("size")[0].as_py()))
    return pa.table([table.column("g")[:1], table.column("block")[:1], pa.array([root])], ["g", "at", "node"])


def _paths(keep: list[str]):
    """Rows of a block and, in a row of its own (at is null), the path above it -> rows with their whole path."""

    def run(table: pa.Table) -> pa.Table:
        is_row = pa.compute.is_valid(table.column("at"))
        above = table.filter(pa.compute.invert(is_row)).column("path").to_pylist()
        above = [(s["left"], s["right"]) for s in above[0]] if above else []
        rows = table.filter(is_row).sort_by("at")
        if not rows.num_rows:
            return rows.select([*keep, "path"])
        paths = [[{"left": a, "right": b} for a, b in p + above] for p in traverse(rows.column("node").to_pylist(), height(rows.column("size")[0].as_py()))]
        return pa.table([*(rows.column(c) for c in keep), pa.array(paths, pa.list_(_STEP))], [*keep, "path"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """df, a written table, broadcast while it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes with `at`, the place of a row among those of its g in the given order, and `size`, how many g has.

    Rows are range-partitioned by (g, order), so a large g spreads over many tasks; sizes of the parts of g in each
    partition give the offsets. Rows that are equal in the order are told apart by where they were read.
    """
    by = ["g", *order, "__tie"]
    parts = nodes.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie")
    rows = written(parts.withColumn("__at", F.monotonically_increasing_id()), name).withColumn("__p", F.shiftright("__at", 33))
    sizes = rows.groupBy("g", "__p").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = W.partitionBy("g").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("g").alias("__g"), F.col("__p").alias("__q"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__off"), F.sum("n").over(W.partitionBy("g")).alias("size"))
    met = rows.join(_small(written(offsets, name + "-offsets")), (F.col("g") == F.col("__g")) & (F.col("__p") == F.col("__q")))
    return met.withColumn("at", F.col("__at") + F.col("__off")).drop("__at", "__p", "__g", "__q", "__off")


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))


def authenticated(nodes: DataFrame, keep: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with `path` from themselves to the root of their g, roots (g, root)); nodes: g, at, size, node, keep.

    Each storey folds blocks into their roots until every g has one, then paths come down again.
    """
    storeys = [_with_block(nodes)]
    while True:
        fold = storeys[-1].select("g", "block", "at", "size", "node").groupBy("g", "block").applyInArrow(_roots, "g string, at long, node string")
        top = written(fold, f"{name}-roots")
        if top.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            break
        sizes = _small(written(top.groupBy(F.col("g").alias("__g")).agg(F.count("*").alias("size")), f"{name}-sizes"))
        storeys.append(_with_block(top.join(sizes, F.col("g") == F.col("__g")).drop("__g")))
    above = None
    for k, storey in reversed(list(enumerate(storeys))):
        kept = keep if k == 0 else ["g", "at"]
        out = [f"{c} {storey.schema[c].dataType.simpleString()}" for c in kept]
        columns = list(dict.fromkeys(["g", "block", "at", "size", "node", *kept]))
        rows = storey.select(*columns, F.lit(None).cast(_PATH).alias("path"))
        if above is not None:
            upper = above.select("g", F.col("at").alias("block"), "path")
            rows = rows.unionByName(upper, allowMissingColumns=True)
        above = rows.groupBy("g", "block").applyInArrow(_paths(kept), ", ".join([*out, f"path {_PATH}"]))
        if k:
            above = written(above, f"{name}-paths")
    return above, top.select("g", F.col("node").alias("root"))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """The leaf of a row with these values: sha256 of each one's length in bytes and text; a null is `-`."""
    return F.sha2(F.concat(*[_field(v) for v in values]).cast("binary"), 256)


def climb(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give; a leaf without siblings anywhere is its own root."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, doc: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, **extra: Column) -> DataFrame:
    """(doc, leaf, extra, path, subroot, root) for each row of docs.

    path lists, level by level from the leaf to the root, the siblings to the left and to the right of the node. extra
    columns are computed beside the leaf and pass through. Sources come in order of their bytes, the null source first
    and apart from the empty one; rows of a source come by id, null ids first, equal ids by their leaf. Repeated rows
    are leaves of their own. An empty table has no rows and no root. Any type of id that can be ordered will do.
    """
    given = {c: F.col(f"`{c}`") for c in {doc, source, *fields}}
    g = F.when(given[source].isNull(), "-").otherwise(F.concat(F.lit("s"), given[source].cast("string")))
    leaves = docs.select(g.alias("g"), given[doc].alias("d"), leaf_of(*[given[f] for f in fields]).alias("node"), *[v.alias(f"x_{k}") for k, v in extra.items()])
    keep = ["g", "d", "node", *[f"x_{k}" for k in extra]]
    rows, subroots = authenticated(ranked(leaves, ["d", "node"], "leaves"), keep, "leaf")
    # the sources are one more tree; its paths continue those of the leaves
    one = subroots.select(F.lit("").alias("g"), F.col("g").alias("d"), F.col("root").alias("node"))
    up, root = authenticated(ranked(one, ["d"], "subroots"), ["d", "node"], "source")
    up = written(up.select(F.col("d").alias("__g"), F.col("node").alias("subroot"), F.col("path").alias("__up")), "source-paths")
    top = root.select("root").first()
    met = rows.join(_small(up), F.col("g") == F.col("__g"))
    return met.select(F.col("d").alias(doc), F.col("node").alias("leaf"), *[F.col(f"x_{k}").alias(k) for k in extra], F.concat("path", "__up").alias("path"), "subroot", F.lit(top[0] if top else None).cast("string").alias("root"))


# The letters whose case a tampered row loses.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots, digest of its path, and whether it verifies after some rows were tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spoilt = [F.translate(F.col(c), UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = manifest(docs, spoilt=F.when(hit, leaf_of(*spoilt)))
    now = F.coalesce("spoilt", "leaf")
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), climb(now, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 8) -> str:
    """The same by SQL: levels of each tree by grouping every 16 nodes, up to 16 ** levels leaves a source."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    bit = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda p, q: {bit.replace('xor(a, b)', 'xor(p, q)')}), 4294967295)"
    out = [
        f"d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS r, doc_id, CASE WHEN source IS NULL THEN '-' ELSE 's' || source END AS g, {leaf('text')} AS leaf,"
        f" CASE WHEN ({crc}) % 5 = 0 THEN {leaf(f'translate(text, {UPPER!r}, {LOWER!r})')} END AS spoilt FROM documents)",
        "a0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY r) - 1 AS p, leaf AS node, r, 1 AS w FROM d)",
    ]

    def tree(tag: str) -> None:
        """tag0 has the nodes; tagK those of level K, a tree's one node stays as it is; tag_path the path of each node of tag0."""
        for k in range(levels):
            out.append(
                f"{tag}{k}s AS MATERIALIZED (SELECT *, p // 16 AS q, count(*) OVER (PARTITION BY g) AS n, list(node) OVER (PARTITION BY g, p // 16 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {tag}{k})"
            )
            out.append(f"{tag}{k + 1} AS MATERIALIZED (SELECT g, q AS p, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY p)) END AS node, min(r) AS r, 1 AS w FROM {tag}{k}s GROUP BY g, q)")
        step = "CASE WHEN s{k}.n > 1 THEN [{{'l': array_to_string(s{k}.run[1:s{k}.p % 16], ''), 'r': array_to_string(s{k}.run[s{k}.p % 16 + 2:], '')}}] ELSE [] END"
        joins = " ".join(f"JOIN {tag}{k}s s{k} ON s{k}.g = s0.g AND s{k}.p = s0.p // {16**k}" for k in range(1, levels))
        out.append(f"{tag}_path AS MATERIALIZED (SELECT s0.g, s0.r, s0.node, {' || '.join(step.format(k=k) for k in range(levels))} AS path FROM {tag}0s s0 {joins})")

    tree("a")
    out.append(f"b0 AS MATERIALIZED (SELECT 'x' AS g, row_number() OVER (ORDER BY g) - 1 AS p, node, row_number() OVER (ORDER BY g) AS r, 1 AS w, g AS source_key FROM a{levels})")
    tree("b")
    out.append("b_up AS (SELECT source_key, b_path.node AS subroot, path FROM b_path JOIN b0 USING (r))")
    out.append(f"v AS (SELECT d.doc_id, d.leaf, coalesce(d.spoilt, d.leaf) AS now, subroot, (SELECT node FROM b{levels}) AS root, a_path.path || b_up.path AS path FROM d JOIN a_path ON d.r = a_path.r JOIN b_up ON b_up.source_key = d.g)")
    fold = "now"
    for k in range(1, 2 * levels + 1):
        out.append(f"v{k} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN len(path) >= {k} THEN sha256(path[{k}].l || {fold} || path[{k}].r) ELSE {fold} END AS now) FROM {'v' if k == 1 else f'v{k - 1}'})")
    proof = "sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), ''))"
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, root, {proof} AS proof_sha256, now AS folded_root, now = root AS verified FROM v{2 * levels}"


SQL = _sql(5)
