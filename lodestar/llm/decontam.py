"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window of a document is as long as an item. Its 64-bit SimHash is compared with those of the items of that
length: fingerprints within RADIUS bits differ in at most RADIUS // BLOCKS bits of at least one of BLOCKS blocks, so
looking up every block, with all its values that near, finds all of them. Candidates are verified by weighted
Jaccard similarity (shingles weigh as often as they occur). Only windows that hold a shingle of some item are
fingerprinted; others have similarity zero.

Items are indexed in numpy tables, in blocks of bounded text. Each block is collected, broadcast, used and released
before the next one, so any benchmark size is whole and none is held at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.common import let_go, pieces, written
from lodestar.llm.shingles import Ranges, shingles, word_hashes

K, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 19, 5
#: Characters of item text in one broadcast index; its tables take about 5 bytes for each.
INDEX_CHARS = 16_000_000
#: Windows fingerprinted at once.
WINDOWS = 4096


def fingerprints(bits: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of n consecutive shingles at each start; bits: +1 or -1 by shingle and bit."""
    sums = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    on = (sums[starts + n] - sums[starts]) > 0
    return (on.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def bits_of(s: np.ndarray) -> np.ndarray:
    return ((s[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int8) * 2 - 1


def blocks_of(fp: np.ndarray) -> list[np.ndarray]:
    """The blocks of each fingerprint."""
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def masks(width: int, radius: int) -> np.ndarray:
    """All words of a width with at most radius bits."""
    return np.array([sum(1 << k for k in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for every place from lo to hi of each row."""
    n = hi - lo
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def index_of(items: list[tuple[int, str | None]], k: int = K) -> dict[str, np.ndarray]:
    """The tables of some items: fingerprints, shingles with counts by item, and the item lengths by shingle."""
    ids, sizes, prints, values, counts, ends = [], [], [], [], [], [0]
    for item, text in items:
        words = word_hashes((text or "").encode())
        if not len(words):
            continue
        s = shingles(words, k)
        v, c = np.unique(s, return_counts=True)
        ids.append(item)
        sizes.append(len(words))
        prints.append(fingerprints(bits_of(s), np.array([0]), len(s))[0])
        values.append(v)
        counts.append(c)
        ends.append(ends[-1] + len(v))
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    size = np.array(sizes, np.int64)
    both = np.unique(np.rec.fromarrays([flat, np.repeat(size, np.diff(ends))], names="s,n"))
    known, first = np.unique(both.s, return_index=True)
    return {
        "ids": _objects(ids), "sizes": size, "prints": np.array(prints, np.uint64), "values": flat, "counts": np.concatenate(counts) if counts else np.zeros(0, np.int64), "ends": np.array(ends),
        "known": known, "first": np.append(first, len(both)), "lengths": np.array(both.n, np.int64),
    }


class Search:
    """Looks up texts in the tables of index_of."""

    def __init__(self, tables: dict[str, np.ndarray], k: int = K):
        self.t, self.k = tables, k
        self.known = tables["known"]
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.short = sorted(set(tables["sizes"][tables["sizes"] < k].tolist()))
        by_size = np.argsort(tables["sizes"], kind="stable")
        cuts = np.flatnonzero(np.diff(tables["sizes"][by_size], prepend=-1))
        self.rows = {int(tables["sizes"][r[0]]): r for r in np.split(by_size, cuts[1:])} if len(by_size) else {}
        self.blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def _hits(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of s that some item has, rows of known)."""
        maybe = np.flatnonzero(self.quick[(s >> np.uint64(44)).astype(np.int64)]) if len(s) and len(self.known) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, s[maybe]), max(0, len(self.known) - 1))
        same = self.known[at] == s[maybe] if len(maybe) else np.zeros(0, bool)
        return maybe[same], at[same]

    def near(self, fp: np.ndarray, n: int) -> np.ndarray:
        """Pairs (window, item) of length n with fingerprints within the radius, by block lookups, in order."""
        rows = self.rows[n]
        if n not in self.blocks:
            tables = []
            for v in blocks_of(self.t["prints"][rows]):
                order = np.argsort(v, kind="stable")
                tables.append((v[order], rows[order]))
            self.blocks[n] = tables
        met = [np.zeros((0, 2), np.int64)]
        for k, ((held, item), own) in enumerate(zip(self.blocks[n], blocks_of(fp))):
            near = masks(64 * (k + 1) // BLOCKS - 64 * k // BLOCKS, RADIUS // BLOCKS)
            if len(held) <= len(near):  # fewer items than near values: compare the blocks as they are
                w, at = np.nonzero(np.bitwise_count(own[:, None] ^ held[None, :]) <= RADIUS // BLOCKS)
            else:
                w, at = [], []
                for x in range(0, len(own), 256):
                    asked = (own[x : x + 256, None] ^ near[None, :]).ravel()
                    row, place = _spread(np.searchsorted(held, asked), np.searchsorted(held, asked, "right"))
                    w.append(x + row // len(near))
                    at.append(place)
                w, at = np.concatenate(w), np.concatenate(at)
            close = np.bitwise_count(fp[w] ^ self.t["prints"][item[at]]) <= RADIUS
            met.append(np.stack([w[close], item[at[close]]], axis=1))
        return np.unique(np.concatenate(met), axis=0)

    def similarity(self, s: np.ndarray, item: int) -> float:
        v, c = np.unique(s, return_counts=True)
        a, b = self.t["ends"][item], self.t["ends"][item + 1]
        values, counts = self.t["values"][a:b], self.t["counts"][a:b]
        at = np.minimum(np.searchsorted(values, v), len(values) - 1)
        both = int(np.minimum(c, counts[at])[values[at] == v].sum())
        return both / (len(s) + int(counts.sum()) - both)

    def __call__(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """(item, first word, similarity) of the best window of every item found in a text."""
        words = word_hashes((text or "").encode())
        best: dict[int, tuple[float, int]] = {}
        runs = []
        s = shingles(words, self.k) if len(words) >= self.k else np.zeros(0, np.uint64)
        hits, row = self._hits(s)
        if len(hits):
            which, place = _spread(self.t["first"][row], self.t["first"][row + 1])
            length, place = self.t["lengths"][place], hits[which]
            runs += [(int(n), self.k, s, place[length == n]) for n in np.unique(length)]
        for n in [m for m in self.short if m <= len(words)]:
            t = Ranges(words).all(n)
            p, _ = self._hits(t)
            if len(p):
                runs.append((n, n, t, p))
        for n, k, s, p in runs:
            size = min(n, len(words)) - k + 1  # shingles in a window
            last = len(s) - size
            change = np.zeros(len(s) + 2, np.int32)
            np.add.at(change, np.clip(p - size + 1, 0, last), 1)
            np.add.at(change, np.clip(p, 0, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(change) > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * size) + 1):
                for x in range(0, len(run), WINDOWS):
                    part = run[x : x + WINDOWS]
                    lo, hi = int(part[0]), int(part[-1]) + size
                    for w, item in self.near(fingerprints(bits_of(s[lo:hi]), part - lo, size), n).tolist():
                        at = int(part[w])
                        sim = self.similarity(s[at : at + size], item)
                        if sim >= threshold - 1e-9 and (item not in best or (sim, -at) > (best[item][0], -best[item][1])):
                            best[item] = (sim, at)
        return [(self.t["ids"][i], at, sim) for i, (sim, at) in sorted(best.items())]


def _search(shared) -> Search:
    """The search over a broadcast index, set up once in each task."""
    let_go()
    return Search(shared.value)


def _each_index(benchmark: DataFrame, item: str, text: str):
    """(broadcast index, whether more than one) over all items; an index is built when asked for."""
    rows = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).filter("t is not null")
    n = max(1, -(-int(rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) // INDEX_CHARS))
    for k in range(n):
        yield benchmark.sparkSession.sparkContext.broadcast(index_of([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).orderBy("i", "t").collect()])), n > 1


def _found(batches: Iterator[pa.RecordBatch], index, kind: pa.DataType, threshold: float) -> Iterator[pa.RecordBatch]:
    names, search = ["d", "item_id", "start_word", "similarity"], _search(index)
    for b in pieces(batches, 1):
        row, items, at, sims = [], [], [], []
        for r, text in enumerate(b.column(1).to_pylist()):
            for i, p, sim in search(text, threshold):
                row.append(r)
                items.append(i)
                at.append(p)
                sims.append(round(sim, 6))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(items, kind), pa.array(at, pa.int64()), pa.array(sims, pa.float64())], names)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, item_id, start_word, similarity): for each row of docs and item its best window, if similar enough.

    Documents shorter than an item are one window. Items under five words are one shingle. Null, empty and blank
    texts and items match nothing; ids of items may be null and of any type; items that repeat each match; repeated rows give repeated results; of windows
    with equal similarity the first is given.
    """
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc}`").alias("d"), F.col(f"`{text}`").alias("t"))
    of_item = benchmark.schema[item].dataType
    found = []
    for shared, more in _each_index(benchmark, item, item_text):
        part = rows.mapInArrow(lambda it, shared=shared: _found(it, shared, to_arrow_type(of_item), threshold), f"d {kind}, item_id {of_item.simpleString()}, start_word long, similarity double")
        found.append(written(part, "found") if more else part)
        if more:
            shared.destroy()
    return reduce(DataFrame.unionByName, found).withColumnRenamed("d", doc)


def _clean(batches: Iterator[pa.RecordBatch], index, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    search = _search(index)
    for b in pieces(batches, at):
        yield b.filter(pa.array([not search(t, threshold) for t in b.column(at).to_pylist()], pa.bool_()))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold an item; all columns stay, rows with null, empty and blank texts too."""
    at = docs.columns.index(text)
    for shared, more in _each_index(benchmark, item, item_text):
        docs = docs.mapInArrow(lambda it, shared=shared: _clean(it, shared, at, threshold), docs.schema)
        if more:
            docs = written(docs, "clean")
            shared.destroy()
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
