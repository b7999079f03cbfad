"""Command line: python -m lodestar COMMAND ... (init, index, reindex, find, who-calls, list, stats, stale, summarize, validate, doctor, export, version)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from lodestar.functions import compat
from lodestar.operators import doctor as health
from lodestar.operators import find, report
from lodestar.plans import indexing
from lodestar.plans.store import Store
from lodestar.schema import GENERATOR_VERSION, SCHEMA_VERSION
from lodestar.session import get_session
from lodestar.sources import files as source

RELATIONS = {"who-calls": find.who_calls, "calls": find.calls, "implementations": find.implementations, "imports": find.imports, "tests-for": find.tests_for}
EXPORTS = {"summary": report.export_summary, "symbols": report.export_symbols, "packages": report.export_packages, "routes": report.export_routes, "diagnostics": report.export_diagnostics}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar")
    p.add_argument("--repo", default="")
    p.add_argument("--format", choices=("json", "agent", "text"), default="text")
    s = p.add_subparsers(dest="command", required=True)
    for name in ("init", "reindex", "stats", "stale", "doctor", "config", "version"):
        s.add_parser(name)
    x = s.add_parser("index")
    x.add_argument("--since", default="")
    x.add_argument("--strict", action="store_true")
    x = s.add_parser("find")
    x.add_argument("what", choices=("symbol", "file", "package", "route", "config"))
    x.add_argument("name")
    x.add_argument("--fuzzy", action="store_true")
    x.add_argument("--exact", action="store_true")
    for o in ("kind", "package", "file", "language", "visibility"):
        x.add_argument(f"--{o}", default="")
    for o in ("include", "exclude"):
        x.add_argument(f"--{o}", action="append", default=[])
    for name in RELATIONS:
        s.add_parser(name).add_argument("name")
    x = s.add_parser("touches")
    x.add_argument("kind")
    x.add_argument("name")
    s.add_parser("list").add_argument("what", choices=("packages", "diagnostics", *find.LISTINGS))
    x = s.add_parser("summarize")
    x.add_argument("what", choices=("file", "package", "symbol"))
    x.add_argument("name")
    s.add_parser("validate").add_argument("--strict", action="store_true")
    x = s.add_parser("export")
    x.add_argument("what", choices=("graph", *EXPORTS))
    x.add_argument("--out", default="")
    return p


def render(rows: list[dict], form: str) -> str:
    if form == "agent":
        return json.dumps(rows, separators=(",", ":"), default=str, ensure_ascii=False)
    if form == "json":
        return json.dumps(rows, indent=2, default=str, ensure_ascii=False)
    return "\n\n".join(_aligned(r) for r in rows)


def _aligned(row: dict) -> str:
    """One key and value a line, the values in one column."""
    wide = max(map(len, row), default=0) + 3
    shown = lambda v: json.dumps(v, default=str, ensure_ascii=False) if isinstance(v, (list, dict)) else "" if v is None else str(v)
    return "\n".join(f"{k + ':':<{wide}}{shown(v)}".rstrip() for k, v in row.items())


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    root = source.repository_root(a.repo)
    config = source.load_config(f"{root}/{source.STATE_DIR}/config.yaml")
    spark = get_session()
    store = Store(spark, f"file://{root}/{source.STATE_DIR}")
    if a.command == "version":
        return _out([{"schema_version": SCHEMA_VERSION, "generator_version": GENERATOR_VERSION}], a)
    if a.command == "config":
        return _out([vars(config)], a)
    if a.command == "init":
        store.init()
        return 0
    if a.command in ("index", "reindex"):
        r = indexing.reindex(spark, root, store, config) if a.command == "reindex" else indexing.index(spark, root, store, config, a.since, a.strict)
        return _out([vars(r)], a)
    if a.command == "doctor":
        return _out(health.doctor(spark, store, root)[0], a)
    t = store.load()
    if a.command == "validate":
        checks, valid = health.validate(spark, t, root, config, a.strict)
        return _out(checks, a) or int(not valid)
    if a.command == "stats":
        size = [{"metric": "store_bytes", "key": "", "n": store.size_bytes()}]
        return _out(_rows(report.stats(t)) + size + [_local_times(r) for r in _rows(report.last_run(t))], a)
    if a.command == "export" and a.out.endswith("/"):
        frames = {"nodes": report.export_nodes(t), "edges": report.export_edges(t)} if a.what == "graph" else {a.what: EXPORTS[a.what](t)}
        for name, df in frames.items():  # large exports: a folder of JSON lines for each, written by the executors
            df.write.mode("overwrite").json(a.out + name)
        return 0
    return _out(_query(t, a), a)


def _local_times(row: dict) -> dict:
    return {k: compat.local_time(v) if k.endswith("_at") and v else v for k, v in row.items()}


def _query(t, a: argparse.Namespace) -> list[dict]:
    if a.command == "find":
        if a.what == "symbol":
            return _rows(find.find_symbol(t, a.name, a.fuzzy, a.kind, a.visibility, a.package, a.file, a.language))
        if a.what == "file":
            return _rows(find.find_file(t, a.name, a.exact, a.include, a.exclude))
        return _rows(find.find_package(t, a.name) if a.what == "package" else find.artifacts_of(t, {"route": "route", "config": "config_key"}[a.what], a.name))
    if a.command in RELATIONS:
        return _rows(RELATIONS[a.command](t, a.name))
    if a.command == "touches":
        return _rows(find.touches(t, a.kind, a.name))
    if a.command == "list":
        return _rows({"packages": find.list_packages, "diagnostics": find.latest_diagnostics}[a.what](t) if a.what in ("packages", "diagnostics") else find.list_artifacts(t, a.what))
    if a.command == "stale":
        return _rows(report.stale_all(t))
    if a.command == "summarize":
        return _rows(_summary(t, a.what, a.name))
    if a.what == "graph":
        return [{"nodes": _rows(report.export_nodes(t)), "edges": _rows(report.export_edges(t))}]
    return _rows(EXPORTS[a.what](t))


def _summary(t, what: str, name: str) -> DataFrame:
    """The summary as it is now: made anew from the index, not read from the stored table."""
    t = t.replace(**indexing.summarised(t, [what]))
    key = {"file": (t.files, "path", t.file_summaries), "package": (t.packages, "name", t.package_summaries), "symbol": (t.symbols, "qualified_name", t.symbol_summaries)}[what]
    one = key[0].filter(key[0][key[1]] == name).orderBy("id").limit(1).select(key[0]["id"].alias("k"))
    return key[2].join(one, key[2][f"{what}_id"] == one["k"], "left_semi")


def _out(rows: list[dict], a: argparse.Namespace) -> int:
    if not rows:
        print("no results", file=sys.stderr)
        return 0
    text = render(rows, a.format)
    if getattr(a, "out", ""):
        with open(a.out, "w") as f:
            f.write(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
