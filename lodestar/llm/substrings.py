"""Substring dedup with suffix automata of reference shards.

Every 35-word window has an anchor: the smallest hash among its 6-word shingles. Equal windows have equal
anchors, so only windows whose anchor comes more than once can repeat. Runs of windows with one anchor are the
references: equal runs are counted, runs that differ go to shards by their anchor. Each shard's suffix automaton
(with end-position counts) is built where its runs are, and the runs stream through it for matching statistics:
a window whose 35 words end in a state of two or more positions repeats. Automata of the whole corpus can't be
broadcast within a bound, and every document against every shard would be quadratic; anchors route each
passage to the one shard that can hold its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, written
from lodestar.llm.shingles import Ranges, sliding_min, word_hashes

WINDOW, ANCHOR = 35, 6
#: An automaton takes at most SHARD words and one anchor's more, 400,000 in all, at some 400 bytes each: 160 MB. An anchor
#: whose different runs hold more than GROUP words is settled by counting window hashes, in any number of tasks.
SHARD, GROUP = 100_000, 300_000
RUNS = "d {doc}, th long, h long, s long, at int, n int, w int"


def runs_of(words: np.ndarray, window: int) -> tuple[np.ndarray, ...] | None:
    """(anchor, content hash, first window, windows, 2 if a window repeats in this text else 1) of each run."""
    if len(words) < window:
        return None
    r = Ranges(words)
    low = sliding_min(r.all(min(ANCHOR, window)), window - min(ANCHOR, window) + 1)
    at = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    n = np.diff(np.append(at, len(low)))
    whole = r.all(window)
    order = np.argsort(whole, kind="stable")
    same = whole[order][1:] == whole[order][:-1]
    twice = np.zeros(len(whole), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return low[at], r(at, at + n + window - 1), at, n, 1 + np.maximum.reduceat(twice.astype(np.int8), at)


def _runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 2):
        ids, parts = [], []
        for k, text in enumerate(b.column(2).to_pylist()):
            got = runs_of(word_hashes((text or "").encode()), window)
            if got is not None:
                parts.append(got)
                ids.append(np.full(len(got[0]), k))
        if parts:
            row = pa.array(np.concatenate(ids))
            h, s, at, n, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(w.astype(np.int32))], ["d", "th", "h", "s", "at", "n", "w"])


class SuffixAutomaton:
    """Generalised suffix automaton over integer symbols, with weighted end-position counts."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, symbols: list[int], weight: int) -> None:
        last = 0
        for c in symbols:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
            else:
                new, p = len(self.next), last
                self.next.append({})
                self.link.append(0)
                self.length.append(self.length[last] + 1)
                self.count.append(0)
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
                last = new
            self.count[last] += weight

    def finish(self) -> None:
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[v] >= 0:
                self.count[self.link[v]] += self.count[v]

    def repeated(self, symbols: list[int], k: int) -> list[bool]:
        """Matching statistics of a text cut at length k: for each k-window, whether it has two positions or more."""
        out, state, n = [], 0, 0
        for c in symbols:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            if n > k:
                n = k
            while state and self.length[self.link[state]] >= n and n:
                state = self.link[state]
            out.append(n == k and self.count[state] >= 2)
        return out[k - 1 :]


def _contents(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Word hashes of the runs asked for in each text."""
    for b in pieces(batches, 0):
        hs, ss, cs, raws = [], [], [], []
        for text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = word_hashes((text or "").encode())
            for a in asked:
                hs.append(a["h"])
                ss.append(a["s"])
                cs.append(a["c"])
                raws.append(words[a["at"] : a["at"] + a["n"] + window - 1].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ss, pa.int64()), pa.array(cs, pa.int64()), pa.array(raws, pa.binary())], ["h", "s", "c", "words"])


def _shard(table: pa.Table, window: int) -> pa.Table:
    runs = sorted(zip(*(table.column(c).to_pylist() for c in ("h", "s", "c", "words")), strict=True))
    texts = [np.frombuffer(x[3], np.uint64).tolist() for x in runs]
    sam = SuffixAutomaton()
    for x, t in zip(runs, texts, strict=True):
        sam.add(t, min(2, x[2]))
    sam.finish()
    out = [(x[0], x[1], np.packbits(sam.repeated(t, window)).tobytes()) for x, t in zip(runs, texts, strict=True) if x[2] < 2]
    h, s, m = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(m, pa.binary())], ["h", "s", "marks"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            words = np.frombuffer(b.column(3)[k].as_py(), np.uint64)
            x = Ranges(words).all(window).view(np.int64)
            cols = [np.full(len(x), b.column(c)[k].as_py(), np.int64) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], ["h", "s", "c", "i", "x"])


def _cut(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 1):
        n_words, n_gone, sums, texts = [], [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()
            gone = 0
            if spans:
                change = np.zeros(len(words) + 1, np.int64)
                for x in spans:
                    hit = np.flatnonzero(np.unpackbits(np.frombuffer(x["marks"], np.uint8))[: x["n"]]) if x["marks"] is not None else np.arange(x["n"])
                    np.add.at(change, x["at"] + hit, 1)
                    np.add.at(change, x["at"] + hit + window, -1)
                covered = np.cumsum(change)[:-1] > 0
                gone = int(covered.sum())
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            else:
                kept = words
            left = b" ".join(kept)
            n_words.append(len(words))
            n_gone.append(gone)
            sums.append(hashlib.sha256(left).hexdigest())
            texts.append(left.decode() if with_text else "")
        cols = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(sums, pa.string())]
        names = ["d", "n_words", "n_removed", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())] if with_text else cols, [*names, "kept_text"] if with_text else names)


def repeated_spans(rows: DataFrame, kind: str, window: int = WINDOW) -> DataFrame:
    """(d, th, at, n, marks, way) of runs with repeated windows; rows: d, th, t. marks: which of the n windows, null: all.

    way: "equal" for runs that come twice as a whole, "automaton", or "counted" for anchors too large for one.
    """
    runs = written(rows.mapInArrow(lambda it: _runs(it, window), RUNS.format(doc=kind)), "runs")
    again = runs.groupBy("h").agg(F.sum("w").alias("c")).filter("c > 1").select("h")
    found = written(runs.join(again, "h", "left_semi"), "repeated")
    # equal runs: two or more repeat as a whole
    each = written(found.groupBy("h", "s").agg(F.count("*").alias("c"), F.min(F.struct("d", "th", "at", "n")).alias("one")), "each")
    words = F.sum(F.col("one.n") + F.lit(window - 1)).alias("words")
    groups = each.groupBy("h").agg(F.min("c").alias("least"), words).filter("least < 2").select("h", "words", (F.col("words") > GROUP).alias("large"))
    asked = each.join(groups, "h").select("h", "s", "c", "one.*", "large")
    by_doc = asked.groupBy("d", "th").agg(F.collect_list(F.struct("h", "s", "c", "at", "n")).alias("asked"))
    once = rows.join(by_doc, rows["d"].eqNullSafe(by_doc["d"]) & (rows["th"] == by_doc["th"]), "inner").select("t", "asked")
    content = written(once.mapInArrow(lambda it: _contents(it, window), "h long, s long, c long, words binary").dropDuplicates(["h", "s"]), "content")
    content = content.join(groups.select("h", "large"), "h")
    small = content.filter("not large")
    shards = max(1, -(-int(small.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]) // (8 * SHARD)))
    # anchors of a shard are packed in hash order, so that no automaton takes more than SHARD words and one anchor's
    packed = groups.filter("not large").withColumn("shard", F.pmod("h", F.lit(shards)))
    before = F.coalesce(F.sum("words").over(W.partitionBy("shard").orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    packed = packed.select(F.col("h").alias("ph"), "shard", F.floor(before / SHARD).alias("part"))
    dealt = small.join(packed, F.col("h") == F.col("ph")).select("shard", "part", "h", "s", "c", "words")
    marked = dealt.groupBy("shard", "part").applyInArrow(lambda t: _shard(t, window), "h long, s long, marks binary")
    # too many different runs for one automaton: windows are counted by hash, in any number of tasks
    wins = content.filter("large").select("h", "s", "c", "words").mapInArrow(lambda it: _windows(it, window), "h long, s long, c long, i int, x long")
    often = wins.groupBy("h", "x").agg(F.sum("c").alias("all")).filter("all > 1").select("h", "x")
    hits = wins.filter("c < 2").join(often, ["h", "x"], "left_semi").groupBy("h", "s").agg(F.collect_set("i").alias("hits"))
    one_by_one = hits.select("h", "s", F.explode("hits").alias("i"))
    whole = each.filter("c > 1").select("h", "s")
    return (
        found.join(whole, ["h", "s"]).select("d", "th", "at", "n", F.lit(None).cast("binary").alias("marks"), F.lit("equal").alias("way"))
        .unionByName(found.join(marked, ["h", "s"]).select("d", "th", "at", "n", "marks", F.lit("automaton").alias("way")))
        .unionByName(found.join(one_by_one, ["h", "s"]).select("d", "th", (F.col("at") + F.col("i")).alias("at"), F.lit(1).alias("n"), F.lit(None).cast("binary").alias("marks"), F.lit("counted").alias("way")))
    )


def dedup_substrings(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc, n_words, n_removed, kept_sha256[, kept_text]) per row: every copy of a repeated window goes, the first too.

    Windows are judged on the input. Rows that share an id are told apart by text; a row that comes twice repeats
    all its windows. Texts under `window` words, empty and null ones lose nothing. Words are compared by 64-bit
    hashes, 35 in a row, so a false match is out of reach.
    """
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc}`").alias("d"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"), F.col(f"`{text}`").alias("t"))
    spans = repeated_spans(rows, kind, window).drop("way")
    of_doc = spans.distinct().groupBy("d", "th").agg(F.collect_list(F.struct("at", "n", "marks")).alias("spans")).withColumnsRenamed({"d": "d2", "th": "th2"})
    all_ = rows.join(of_doc, rows["d"].eqNullSafe(of_doc["d2"]) & (rows["th"] == of_doc["th2"]), "left").select("d", "t", "spans")
    out = f"d {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return all_.mapInArrow(lambda it: _cut(it, window, with_text), out).withColumnRenamed("d", doc)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
