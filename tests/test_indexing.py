"""A small repository from the first run through changes and deletions."""

import os
import time

import pytest

from lodestar.operators import doctor as health
from lodestar.operators import find, maintain
from lodestar.plans.indexing import index
from lodestar.plans.store import Store
from lodestar.sources.files import Config


@pytest.fixture
def repo(tmp_path):
    """A shop: a command that calls into a stock package, and a vendored file that is left out."""
    (tmp_path / "r/stock").mkdir(parents=True)
    (tmp_path / "r/go.mod").write_text("module example.com/shop\n")
    (tmp_path / "r/shop.go").write_text('package main\n\nimport "fmt"\n\nfunc main() { fmt.Println(stock.Count()) }\n')
    (tmp_path / "r/stock/count.go").write_text("package stock\n\nfunc Count() int { return 1 }\n")
    (tmp_path / "r/vendor").mkdir()
    (tmp_path / "r/vendor/x.go").write_text("package x\n")
    return tmp_path


def names(t):
    return {r[0] for r in t.symbols.select("qualified_name").collect()}


def test_life_of_an_index(spark, repo):
    root, store = str(repo / "r"), Store(spark, f"file://{repo}/store")
    store.init()
    first = index(spark, root, store)
    assert (first.files_scanned, first.files_changed, first.status) == (2, 2, "success")
    t = store.load()
    assert names(t) == {"main.main", "stock.Count"}
    assert find.who_calls(t, "stock.Count").count() == 1
    assert find.imports(t, "fmt").count() == 1
    checks, valid = health.validate(spark, t, root, strict=True)
    assert valid, checks
    assert health.doctor(spark, store, root)[1]

    assert index(spark, root, store).files_changed == 0

    time.sleep(0.01)
    (repo / "r/shop.go").write_text("package main\n\nfunc other() { stock.Count() }\n")
    assert index(spark, root, store).files_changed == 1
    t = store.load()
    assert names(t) == {"main.other", "stock.Count"}
    ids = {r["path"]: r["id"] for r in t.files.collect()}
    assert ids == {"shop.go": 1, "stock/count.go": 2}

    os.remove(repo / "r/stock/count.go")
    assert index(spark, root, store).files_deleted == 1
    t = store.load()
    assert names(t) == {"main.other"}
    r = t.refs.filter("reference_kind = 'calls'").first()
    assert r["to_symbol_id"] is None and r["is_resolved"]  # a deleted file leaves its incoming references resolved


def test_illegal_kind_ends_a_file(spark, repo):
    (repo / "r/a.py").write_text("def f():\n    pass\n@dec\ndef g():\n    pass\n")
    root = str(repo / "r")
    for compat, status in (("reference", "partial"), ("fixed", "success")):
        store = Store(spark, f"file://{repo}/s-{compat}")
        store.init()
        assert index(spark, root, store, Config(compat=compat)).status == status


def test_numbers_are_consecutive(spark, tmp_path):
    n = [0]

    def stage(df, name):
        n[0] += 1
        at = f"{tmp_path}/{n[0]}"
        df.write.parquet(at)
        return spark.read.parquet(at)

    df = spark.createDataFrame([(f"p{i:03}", i) for i in range(100, 0, -1)], "path string, v int").repartition(7)
    got = maintain.numbered(df, ["path"], stage, after=10).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(11, 111)) and [r["v"] for r in got] == list(range(1, 101))


def test_continuous_indexing_sees_new_and_changed_files(spark, repo):
    from lodestar.streaming.continuous import watch

    root, store = repo / "r", Store(spark, f"file://{repo}/stream")
    store.init()
    go = lambda: watch(spark, str(root), store, f"file://{repo}/ck").awaitTermination(120)
    go()
    assert names(store.load()) == {"main.main", "stock.Count"}
    (root / "stock/count.go").write_text("package stock\n\nfunc Total() int { return 2 }\n")
    (root / "more.go").write_text("package main\n\nfunc extra() {}\n")
    (root / "big.go").write_text("package main\n" + "// x\n" * 300_000)  # over the size limit
    go()
    assert names(store.load()) == {"main.main", "stock.Total", "main.extra"}
    before = store.version()
    go()
    assert store.version() == before


def test_versions_and_crashes(spark, repo, monkeypatch):
    from lodestar.plans import indexing

    root, store = str(repo / "r"), Store(spark, f"file://{repo}/store")
    store.init()
    index(spark, root, store)
    places = store.manifest(1)
    index(spark, root, store)  # nothing changed: tables stay where they lie
    assert {n: p for n, p in store.manifest(2).items() if n not in ("index_runs", "diagnostics")} == {n: p for n, p in places.items() if n not in ("index_runs", "diagnostics")}
    # a writer that dies before its manifest leaves the version before it
    (repo / "store/v=3/files").mkdir(parents=True)
    assert store.version() == 2 and names(store.load()) == {"main.main", "stock.Count"}
    # a run that fails is logged, and the tables stay
    (repo / "r/shop.go").write_text("package main\n")
    with monkeypatch.context() as m:
        m.setattr(indexing, "extract", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index(spark, root, store)
    t = store.load()
    assert [r["status"] for r in t.index_runs.orderBy("id").collect()] == ["success", "success", "failed"] and names(t) == {"main.main", "stock.Count"}
    assert store.get_meta("running") == ""
    assert index(spark, root, store).files_changed == 1 and store.load().index_runs.filter("files_reparsed = 1").count() == 1
    assert len(store.versions()) == Store.KEEP and not os.path.exists(repo / "store/v=3/files")
    for n in os.listdir(repo / "store"):
        if n.startswith("manifest-"):
            os.remove(repo / "store" / n)
    with pytest.raises(RuntimeError):
        store.version()


def test_reindex_and_meta(spark, repo):
    from lodestar.plans.indexing import reindex

    root, store = str(repo / "r"), Store(spark, f"file://{repo}/store")
    store.init()
    store.init()
    index(spark, root, store)
    assert reindex(spark, root, store).files_changed == 2
    t = store.load()
    assert names(t) == {"main.main", "stock.Count"} and t.index_runs.count() == 1
    store.set_meta("owner", "a")
    store.set_meta("owner", "b")
    assert store.get_meta("owner") == "b" and store.get_meta("none") is None and store.size_bytes() > 0


def test_unreadable_and_vanished_files(spark, repo, monkeypatch):
    from lodestar.plans.indexing import index_rows
    from lodestar.sources import files as source

    root, store = str(repo / "r"), Store(spark, f"file://{repo}/store")
    store.init()
    candidates = source.walk(spark, root)
    os.remove(repo / "r/stock/count.go")  # listed by the plan already: left out
    ghost = spark.createDataFrame([("ghost.go",)], "path string")  # listed, but its content can't be read
    monkeypatch.setattr(source, "listing", lambda c: c.select("path").union(ghost))
    r = index_rows(spark, candidates, store, Config())
    assert r.files_scanned == 1 and r.errors == 1 and r.status == "partial"
    assert [(x["code"], x["message"]) for x in store.load().diagnostics.collect()] == [("FILE_MISSING", "cannot read file ghost.go")]


def test_settings_in_sections(tmp_path):
    from lodestar.sources.files import config_of, load_config

    (tmp_path / "c.yaml").write_text("indexing:\n  max_file_size_bytes: 10\n  exclude: ['x/**']\nsummaries:\n  enabled: false\n  symbol: false\ncompat: fixed\n")
    c = load_config(str(tmp_path / "c.yaml"))
    assert (c.max_size, c.exclude, c.summaries, c.summary_kinds, c.compat) == (10, ["x/**"], False, ["file", "package"], "fixed")
    assert config_of({"summaries": False}).summaries is False and config_of({}).summaries is True and load_config(str(tmp_path / "none")) == Config()


def test_command_line(spark, repo, capsys):
    import json
    import subprocess

    from lodestar import __main__ as cli

    root = repo / "r"
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "--allow-empty", "-m", "x"], check=True)
    run = lambda *a: (cli.main(["--repo", str(root), *a]), capsys.readouterr().out)[1]
    assert run("init") == "" and "files_changed:" in run("index")
    assert json.loads(run("--format", "json", "find", "symbol", "Count"))[0]["qualified_name"] == "stock.Count"
    assert json.loads(run("--format", "agent", "who-calls", "stock.Count"))[0]["from_file"] == "shop.go"
    assert "store_bytes" in run("stats")
    (root / "stock/count.go").write_text("package stock\n\nfunc Count() int { return 3 }\nfunc Sum() {}\n")
    assert "stock/count.go" in "".join(__import__("lodestar.sources.files", fromlist=["x"]).walk(spark, str(root)).select("path").toPandas()["path"])
    assert json.loads(run("--format", "json", "index", "--since", "HEAD"))[0]["mode"] == "incremental"
    assert "symbol_id" in run("summarize", "symbol", "stock.Count") and json.loads(run("--format", "json", "summarize", "file", "shop.go"))[0]["summary_text"]
    assert run("export", "graph", "--out", str(repo / "g.json")) == "" and "nodes" in (repo / "g.json").read_text()
    assert run("export", "graph", "--out", f"{repo}/g/") == "" and spark.read.json(f"{repo}/g/nodes").count() == spark.read.json(f"{repo}/g/nodes").select("stable_id").distinct().count() > 1
    assert cli.main(["--repo", str(root), "validate"]) == 0
    capsys.readouterr()
