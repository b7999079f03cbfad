"""The tree source: every name, the same rows by walk, path list and stream, filters in the walk."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestar.plans.indexing import index
from lodestar.plans.store import Store
from lodestar.sources import files as source
from lodestar.sources import tree

NAMES = ["pkg/ok.py", "pkg/__init__.py", "pkg/_private.py", "pkg/__main__.py", "web/__tests__/a.test.ts", ".github/b.py", "_gen/c.go", "deep/a/b/c/d.rs", "top.go", "sp ace/ü.py"]


@pytest.fixture
def ten(tmp_path):
    root = tmp_path / "r"
    for n in [*NAMES, ".git/x.py", "pkg/.lodestar/y.py", "vendor/v.go", "pkg/notes.txt"]:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(f"# {n}\n")
    return root


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_ten_files_by_every_way(spark, ten):
    want = sorted(NAMES)
    walked = source.walk(spark, str(ten))
    assert paths(walked) == want
    asked = [*NAMES, "gone.py", "pkg", "../r/top.go", ".git/x.py", "vendor/v.go", "pkg/.lodestar/y.py", "pkg/notes.txt"]
    named = source.stat(spark, str(ten), asked)
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, walked.collect()))
    assert paths(source.on_disk(spark, str(ten))) == sorted([*NAMES, "vendor/v.go", "pkg/notes.txt"])
    read = {r["path"]: bytes(r["content"]) for r in tree.contents(walked, str(ten)).collect()}
    assert read == {n: f"# {n}\n".encode() for n in NAMES}
    assert source.stat(spark, str(ten), []).count() == 0


def test_filters_reach_the_walk(spark, ten):
    (ten / "big.py").write_text("x" * 3000)
    all_ = tree.tree(spark, str(ten))
    assert paths(all_.filter("path in ('top.go', 'pkg/ok.py', 'none.py', '.git/x.py')")) == ["pkg/ok.py", "top.go"]
    assert paths(all_.filter("path = 'big.py' and size_bytes > 100")) == ["big.py"]
    assert paths(all_.filter("size_bytes <= 2999 and path like 'pkg/%' and path like '%.py'")) == ["pkg/__init__.py", "pkg/__main__.py", "pkg/_private.py", "pkg/ok.py"]
    reader = tree.TreeReader({"root": str(ten)})
    assert list(reader.pushFilters([tree.LessThanOrEqual(("size_bytes",), 10), tree.EqualTo(("path",), "top.go")])) == [] and reader.paths == ["top.go"]
    assert paths(source.walk(spark, str(ten), source.Config(max_size=2999))) == sorted(NAMES)


def test_links_pipes_and_divisions(spark, ten, tmp_path):
    os.symlink(ten / "top.go", ten / "link.go")
    os.symlink(ten / "pkg", ten / "loop.py")
    os.symlink(tmp_path / "nowhere", ten / "broken.py")
    os.mkfifo(ten / "pipe.py")
    assert paths(source.walk(spark, str(ten))) == sorted([*NAMES, "link.go", "broken.py"])
    want = sorted(r[0] for r in tree.below(str(ten), "", True))
    for parts in (1, 2, 3, 7, 100):
        jobs = tree.divided(str(ten), parts)
        assert len(jobs) <= parts and sorted(r[0] for part in jobs for folder, deep in part for r in tree.below(str(ten), folder, deep)) == want
    assert list(tree.below(str(tmp_path / "missing"), "", True)) == []


def test_incremental_and_full_runs_agree(spark, ten, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(ten), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    subprocess.run(["rm", "-rf", str(ten / ".git")], check=True)
    git("init", "-q")
    git("commit", "-q", "--allow-empty", "-m", "x")
    git("add", "pkg", "web", ".github", "_gen")
    store = Store(spark, f"file://{tmp_path}/store")
    store.init()
    first = index(spark, str(ten), store, since="HEAD")
    assert first.mode == "incremental" and first.files_changed == 7
    second = index(spark, str(ten), store)
    assert (second.files_deleted, second.files_changed) == (0, 3)
    assert paths(store.load().files) == sorted(NAMES)
    from lodestar.operators import doctor

    assert doctor.files_on_disk(store.load(), str(ten)) == 0 and doctor.unindexed_files(store.load(), source.walk(spark, str(ten))).count() == 0


def test_states_of_a_watched_tree():
    from lodestar.streaming.continuous import TICK_NS, compared

    now = 10 * TICK_NS
    out, state = compared({"a": (1, 5), "b": (2, now)}, {}, now)
    assert sorted(out) == [("a", "new"), ("b", "new")] and state == {"a": (1, 5), "b": (2, -1)}
    assert compared({"a": (1, 5), "b": (2, now)}, state, now * 2) == ([("b", "changed")], {"a": (1, 5), "b": (2, now)})  # once more
    out, state = compared({"b": (2, now), "old": (1, 1)}, {"a": (1, 5), "b": (2, now)}, now * 2)
    assert sorted(out) == [("a", "deleted"), ("old", "new")] and state == {"b": (2, now), "old": (1, 1)}


def test_moved_in_and_deleted_files_are_seen(spark, ten, tmp_path):
    from lodestar.streaming.continuous import watch

    store = Store(spark, f"file://{tmp_path}/store")
    store.init()
    go = lambda: watch(spark, str(ten), store, f"file://{tmp_path}/ck", groups=3).awaitTermination(180)
    now = os.stat(ten / "top.go").st_mtime_ns + 3600 * 10**9
    os.utime(ten / "top.go", ns=(now, now))  # not older than the listing
    go()
    assert paths(store.load().files) == sorted(NAMES)
    (tmp_path / "old.py").write_text("def moved(): pass\n")
    os.utime(tmp_path / "old.py", (1, 1))
    os.rename(tmp_path / "old.py", ten / "old.py")
    os.remove(ten / "pkg/ok.py")
    (ten / "top.go").write_text("# TOP.go\n")  # the same size within the tick
    os.utime(ten / "top.go", ns=(now, now))
    go()
    t = store.load()
    assert paths(t.files) == sorted([*set(NAMES) - {"pkg/ok.py"}, "old.py"])
    assert t.files.filter("path = 'top.go'").select("content_hash").first() == spark.range(1).select(F.sha2(F.lit("# TOP.go\n").cast("binary"), 256)).first()
