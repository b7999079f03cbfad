"""Substring dedup against counting every window."""

import collections
import hashlib
import random

import pytest

from lodestar.llm import substrings


def brute(docs, window):
    count, words = collections.Counter(), []
    for _, t in docs:
        w = (t or "").encode().split()
        words.append(w)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("window", "group"), [(35, 300_000), (9, 300_000), (9, 60)])
def test_small(spark, monkeypatch, window, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    r = random.Random(window)
    docs = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(40)]
    docs += [(1000, "a " * 80), (1001, None), (1002, ""), (1002, "x y"), (None, "q " * 3), (1003, "b a " * 40), (1003, "b a " * 40)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, h string")
    assert rows_of(substrings.dedup_substrings(df, window=window)) == brute(docs, window)


def test_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(substrings.op7_substring_dedup(spark, sf)) == brute(docs, 35)


def test_empty_and_kept_text(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    passage = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"a {passage} b"), (2, f"{passage} c")], "doc_id long, text string")
    assert {r["kept_text"] for r in substrings.dedup_substrings(df, with_text=True).collect()} == {"a b", "c"}


def test_automata_are_bounded_by_their_words(spark, monkeypatch, tmp_path):
    """Shards are cut where they exceed SHARD words, wherever the hashes of anchors fall."""
    monkeypatch.setattr(substrings, "SHARD", 60)
    seen, real = f"{tmp_path}/seen", substrings._shard

    def spy(table, window):
        words = [len(x) // 8 for x in table.column("words").to_pylist()]
        with open(seen, "a") as f:
            f.write(f"{sum(words) - max(sum(n for n, h in zip(words, table.column('h').to_pylist(), strict=True) if h == a) for a in set(table.column('h').to_pylist()))}\n")
        return real(table, window)

    monkeypatch.setattr(substrings, "_shard", spy)
    r = random.Random(1)
    passages = [" ".join(f"w{r.randrange(10**6)}" for _ in range(50)) for _ in range(60)]
    docs = [(i, f"{p} tail{i} " + " ".join(f"t{i}x{k}" for k in range(i % 7))) for i, p in enumerate(passages * 2)]
    assert rows_of(substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), window=35)) == brute(docs, 35)
    rest = [int(x) for x in open(seen)]
    assert len(rest) > 20 and max(rest) <= 60 + 100  # what there is besides the largest anchor
