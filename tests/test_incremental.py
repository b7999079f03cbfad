"""Runs over change sets against runs from scratch; what is read and written, and two writers."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators import maintain
from lodestar.plans import indexing
from lodestar.plans.indexing import index, index_rows, summarised
from lodestar.plans.store import Change, Store
from lodestar.sources.files import Config
from lodestar.streaming import continuous  # noqa: F401  the stream is tested in test_tree

#: Columns that say where a row was made, not what it is.
WHEN = {"id", "created_at", "updated_at", "last_modified_utc", "run_id"}


def write(root, path, text):
    at = os.path.join(root, path)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "w") as f:
        f.write(text)
    os.utime(at, (10**9, 10**9 + random.randrange(10**6)))


def module(name, *calls, more=""):
    return f"import lib_{name}\n{more}\ndef {name}():\n" + "".join(f"    {c}()\n" for c in calls) + "    return 1\n\nclass Box:\n    def open(self):\n        pass\n"


def tree_of(root):
    for i in range(24):
        write(root, f"p{i % 5}/m{i}.py", module(f"f{i}", f"p{(i + 1) % 24 % 5}.m{(i + 1) % 24}.f{(i + 1) % 24}", "p0.m0.f0", "later.f", more=f"KEY_{i} = os.getenv('K{i}')"))
    write(root, "go/a.go", "package shop\n\nimport \"fmt\"\n\nfunc A() { fmt.Println(shop.B()) }\n")
    write(root, "go/b.go", "package shop\n\nfunc B() int { return 1 }\n")
    write(root, "bad.py", "@x\ndef f(): pass\n")


def edit(root, r):
    """Changes, renames, deletions, additions and moves of symbols between files."""
    for i in r.sample(range(24), 6):
        write(root, f"p{i % 5}/m{i}.py", module(f"f{i}" if r.random() < 0.5 else "g", "later.f", "p1.m1.f1"))
    i = r.randrange(24)
    os.remove(f"{root}/p{i % 5}/m{i}.py")
    os.remove(f"{root}/go/a.go")
    write(root, "new/later.py", module("f", f"p{i % 5}.m{i}.f{i}"))
    write(root, "go/c.go", "package shop\n\nfunc B() int { return 2 }\n")  # takes the stable id of go/b.go's B over
    write(root, "later.py", "def f(): pass\n")
    write(root, "bad.py", "def f(): pass\n")


def content(t):
    """The index without ids: names in place of keys."""
    f, s, p = (getattr(t, n).select(F.col("id").alias(f"{n}_k"), F.col(c).alias(f"{n}_v")) for n, c in (("files", "path"), ("symbols", "stable_id"), ("packages", "directory_path")))
    keys = {"file_id": (f, "files"), "from_file_id": (f, "files"), "to_file_id": (f, "files"), "symbol_id": (s, "symbols"), "from_symbol_id": (s, "symbols"), "to_symbol_id": (s, "symbols"), "parent_symbol_id": (s, "symbols"), "package_id": (p, "packages")}
    out = {}
    for n in ("files", "packages", "package_files", "symbols", "refs", "artifacts", "file_summaries", "package_summaries", "symbol_summaries"):
        df = getattr(t, n)
        for c, (names, k) in keys.items():
            if c in df.columns:
                df = df.join(names, F.col(c) == F.col(f"{k}_k"), "left").drop(c, f"{k}_k").withColumnRenamed(f"{k}_v", c)
        out[n] = sorted(map(str, df.select(*sorted(set(df.columns) - WHEN)).collect()))
    return out


@pytest.mark.parametrize("compat", ["reference", "fixed"])
def test_edits_against_a_run_from_scratch(spark, tmp_path, compat):
    root, r, config = str(tmp_path / "r"), random.Random(7), Config(compat=compat)
    tree_of(root)
    store = Store(spark, f"file://{tmp_path}/store", bucket_rows=12)
    store.init()
    index(spark, root, store, config)
    assert store.manifest(1)["refs"]["buckets"] > 5
    edit(root, r)
    index(spark, root, store, config)
    t = store.load()
    # references: none would be resolved that is not, none has an end that is gone
    again = maintain.resolve(t.refs, t.symbols, compat)
    assert again.exceptAll(t.refs).count() == 0
    for k, made in summarised(t, config.summary_kinds).items():
        assert sorted(map(str, made.collect())) == sorted(map(str, getattr(t, k).collect())), k
    for n in ("files", "symbols", "refs", "artifacts"):
        assert getattr(t, n).count() == getattr(t, n).select("id").distinct().count()
    if compat == "fixed":
        return
    # all but what depends on the order of runs (which of its files names a package, references that a deleted file leaves resolved)
    fresh = Store(spark, f"file://{tmp_path}/fresh")
    fresh.init()
    index(spark, root, fresh, config)
    got, want = content(t), content(fresh.load())
    for n in ("files", "package_files", "symbols", "artifacts", "file_summaries"):
        assert got[n] == want[n], n


def test_only_touched_buckets_are_written_and_only_suspects_are_read(spark, tmp_path):
    root = str(tmp_path / "r")
    tree_of(root)
    store = Store(spark, f"file://{tmp_path}/store", bucket_rows=6)
    store.init()
    index(spark, root, store)
    before = store.manifest(1)
    # other bytes behind a known size and an old time are not opened
    at = os.stat(f"{root}/go/b.go")
    with open(f"{root}/go/b.go", "w") as f:
        f.write("package shop\n\nfunc B() int { return 7 }\n")
    os.utime(f"{root}/go/b.go", ns=(at.st_atime_ns, at.st_mtime_ns))
    write(root, "p3/m3.py", module("f3", "nothing.here"))
    one = index(spark, root, store)
    assert (one.files_scanned, one.files_changed) == (27, 1)
    after = store.manifest(2)
    for n in ("refs", "symbols", "artifacts", "symbol_summaries"):
        assert before[n]["buckets"] == after[n]["buckets"] > 3
        kept = set(before[n]["parts"].values()) & set(after[n]["parts"].values())
        assert len(kept) >= len(before[n]["parts"]) - 3, n
    # a time of its own gives it away; a file that is touched alone is no change, and is known the next time
    os.utime(f"{root}/go/b.go")
    os.utime(f"{root}/p1/m1.py", (2 * 10**9, 2 * 10**9))
    assert index(spark, root, store).files_changed == 1
    assert store.load().files.filter("path = 'p1/m1.py'").first()["last_modified_utc"] == "2033-05-18T03:33:20Z"


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    rows = lambda *names: spark.createDataFrame([(f"{n}.py", "python", 1, 10**18, bytearray(f"def {n}(): pass\n".encode())) for n in names], "path string, language string, size_bytes long, mtime_ns long, content binary")
    one, two = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    one.init()
    index_rows(spark, rows("a"), one, Config(), mode="incremental")
    real, met = indexing.extract, []

    def meanwhile(*args):
        if not met:
            met.append(index_rows(spark, rows("b", "a2"), two, Config(), mode="incremental").run_id if met.append(0) is None else None)
        return real(*args)

    monkeypatch.setattr(indexing, "extract", meanwhile)
    assert index_rows(spark, rows("c"), one, Config(), mode="incremental").run_id == 3
    t = one.load()
    assert {r["name"] for r in t.symbols.collect()} == {"a", "b", "a2", "c"} and t.index_runs.count() == 3
    assert sorted(r["id"] for r in t.files.collect()) == [1, 2, 3, 4]
    # a claim that another writer left without a manifest does not stand in the way for ever
    one.fs.create(one._p(f"{one.path}/_claims/4"), False).close()
    monkeypatch.setattr(Store, "CLAIM_SECONDS", 1)
    one.publish(4, {"index_runs": Change(fresh=t.index_runs.limit(0))})
    assert one.version() == 4


def test_stabbing_against_all_pairs(spark):
    r = random.Random(3)
    symbols = [(i, r.randrange(6), a := r.randrange(40), a + r.choice([0, 0, 1, 3, 20, -2])) for i in range(300)] + [(900, None, 1, 9), (901, 1, None, 9), (902, 1, 1, None)]
    refs = [(i, r.choice([0, 1, 2, 3, 4, 5, 9, None]), r.choice([*range(60), None])) for i in range(500)]
    got = {(x["id"], x["from_symbol_id"]) for x in maintain.enclosing_symbols(spark.createDataFrame(refs, "id long, from_file_id long, line long"), spark.createDataFrame(symbols, "id long, file_id long, start_line long, end_line long")).collect()}
    want = set()
    for i, f, line in refs:
        inside = [(b - a, s) for s, sf, a, b in symbols if None not in (f, line, sf, a, b) and f == sf and a <= line <= b]
        if inside:
            want.add((i, min(inside)[1]))
    assert got == want


def test_stabbing_is_linear_in_a_large_nested_file(spark):
    symbols = spark.range(10_000).selectExpr("id", "1L file_id", "id + 1 start_line", "40000 - id end_line")
    refs = spark.range(50_000).selectExpr("id", "1L from_file_id", "id % 25000 line")
    start = time.time()
    rows = maintain.enclosing_symbols(refs, symbols).collect()
    assert len(rows) == 49_998 and all(r["from_symbol_id"] == min(r["id"] % 25_000, 10_000) - 1 for r in rows)
    assert time.time() - start < 30
