"""The Merkle manifest against a tree made level by level in plain Python."""

import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from lodestar.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        out.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return out


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text) -> sorted result rows of the query."""
    of = {}
    for r in rows:
        of.setdefault(r[1], []).append(r)
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        of[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels_of([leaf(r) for r in of[s]])
    upper = levels_of([trees[s][-1][0] for s in names])
    root, out = upper[-1][0] if names else None, []
    for k, s in enumerate(names):
        for i, r in enumerate(of[s]):
            path = path_of(trees[s], i) + path_of(upper, k)
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4])))
            for left, right in path:
                node = h(left, node, right)
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


DDL = "doc_id long, source string, lang string, n_chars long, text string"


def query(spark, rows, tmp_path, ddl=DDL):
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, f"file://{tmp_path}")
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_sources_of_all_sizes(spark, tmp_path):
    rows = []
    for s, n in (("one", 1), ("two", 2), ("run", 16), ("more", 17), ("block", 256), ("over", 257), ("b2", 4096), ("big", 4370), ("", 3), (None, 18), ("é", 5), ("Z", 33), *((f"t{k}", 1) for k in range(9))):
        rows += [(7919 * len(rows) % 104729, s, "en", k, f"Text {k} É") for k in range(n)]
    got = query(spark, rows, tmp_path)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, None, None, None, "A"), (5, "s", None, 1, None), (5, "s", None, 1, None), (5, "s", "x", -1, ""), (2, "s", "x", 0, "LONG" * 200_000), *[(9, "s", "en", 4, "Same")] * 300, (3, "-", "a:b", 2, "c"), (4, "t", "3:a", 2, "ß\n\x00")]
    got = query(spark, [(*r, "clash", "clash", 1, 2, 3) for r in rows], tmp_path, DDL + ", g string, node string, at long, size long, __g long")
    assert got == brute(rows)


def test_empty_table_and_ids_of_other_types(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
    rows = [(f"id{k}", "s" if k % 3 else None, f"Text {k}") for k in range(40)]
    out = merkle.manifest(spark.createDataFrame(rows, "key string, source string, text string"), doc="key", fields=("key", "text")).withColumn("again", merkle.climb(F.col("leaf"), F.col("path"))).collect()
    assert len(out) == 40 and all(r["again"] == r["root"] and r["leaf"] == leaf((r["key"], f"Text {r['key'][2:]}")) for r in out)


def test_traversal_keeps_few_nodes():
    nodes = [h(str(k)) for k in range(256)]
    ahead = merkle._Ahead(0, nodes)
    assert len(ahead.run) == 16 and len(ahead.next) == 0
    for n in (1, 15, 16, 17, 255, 256):
        tree = levels_of(nodes[:n])
        assert list(merkle.traverse(nodes[:n], len(tree) - 1)) == [path_of(tree, i) for i in range(n)]
        assert merkle.block_root(nodes[:n], len(tree) - 1) == tree[-1][0]
