"""Indexing: scan, skip what is unchanged, extract, merge, resolve, summarise, publish."""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.extract.registry import scan as extract
from lodestar.operators import maintain as m
from lodestar.plans import changes
from lodestar.plans.changes import COUNTED, Setting, summarised
from lodestar.plans.store import Change, Conflict, Draft, Store
from lodestar.schema import IndexTables
from lodestar.sources import files as source

__all__ = ["RunResult", "index", "index_rows", "reindex", "summarised"]

#: Seconds by which the clocks of the driver and of the tree's file system may differ.
CLOCKS = 2
#: How often a run is taken up again after another one came first.
ATTEMPTS = 5


@dataclass(frozen=True)
class RunResult:
    run_id: int
    status: str
    mode: str
    files_scanned: int
    files_changed: int
    files_deleted: int
    symbols_written: int
    references_written: int
    errors: int
    warnings: int


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def index(spark: SparkSession, root: str, store: Store, config: source.Config = source.Config(), since: str = "", strict: bool = False) -> RunResult:
    """One run over a source tree. since: only files that differ from that revision, and no deletions.

    Raises with strict when there were errors. The old snapshot stays whole until the new one is published.
    """
    candidates = source.stat(spark, root, source.diff_files(root, since), config) if since else source.walk(spark, root, config)
    return index_rows(spark, candidates, store, config, "incremental" if since else "full", source.module_path(root), source.head_commit(root), strict)


def reindex(spark: SparkSession, root: str, store: Store, config: source.Config = source.Config(), strict: bool = False) -> RunResult:
    store.clear()
    return index(spark, root, store, config, strict=strict)


def index_rows(spark: SparkSession, candidates: DataFrame, store: Store, config: source.Config, mode: str = "full", module_path: str = "", commit: str = "", strict: bool = False, removed: DataFrame | None = None, quiet: bool = False) -> RunResult:
    """A run over candidate rows (path, size_bytes, mtime_ns, language, and the root to read them from, or their content).

    A full run takes files that are not among the candidates for deleted; other runs only those of `removed` (path).
    A quiet run that finds nothing new makes no version. The run's row is `running` in a marker beside the index while it lasts. A run that fails is logged as `failed`
    with the old tables, and its error is raised. A listed file that can't be read gets a FILE_MISSING diagnostic. A
    run that finds another one's version in its way starts again from that version, so nothing of either is lost.
    """
    for attempt in range(ATTEMPTS):
        old = store.load()
        run = store.version() + 1
        _mark(store, str(run))
        try:
            return _run(spark, candidates, store, config, mode, module_path, commit, strict, removed, quiet, old, run)
        except _StrictError:
            raise
        except Conflict:
            if attempt == ATTEMPTS - 1:
                raise
        except Exception as e:
            row = {"id": run, "started_at": _now(), "finished_at": _now(), "status": "failed", "mode": mode, "git_commit": commit or None, "notes": f"{type(e).__name__}: {e}"[:500]}
            store.publish(run, {"index_runs": Change(fresh=_run_row(spark, old, row), added=1)})
            raise
        finally:
            store.drop_stage()
            _mark(store, "")
    raise AssertionError


def _mark(store: Store, value: str) -> None:
    """The marker is for onlookers; another writer may be setting it at the same time."""
    try:
        store.set_meta("running", value)
    except RuntimeError:
        pass


class _StrictError(RuntimeError):
    pass


def _run_row(spark: SparkSession, old: IndexTables, row: dict) -> DataFrame:
    return spark.createDataFrame([tuple(row.get(c) for c in old.index_runs.columns)], old.index_runs.schema)


def _ids(store: Store, old: IndexTables, first: bool) -> dict[str, int]:
    """The greatest ids given so far; a store without such marks is asked for them."""
    marks = store.marks(store.version()).get("ids")
    return marks or ({} if first else {n: m.greatest(getattr(old, n)) for n in COUNTED})


def _run(spark: SparkSession, candidates: DataFrame, store: Store, config: source.Config, mode: str, module_path: str, commit: str, strict: bool, removed: DataFrame | None, quiet: bool, old: IndexTables, run: int) -> RunResult:
    began = datetime.datetime.now(datetime.timezone.utc)
    started = _now()
    stage = store.stage(run)
    version = store.version()
    first = not store.manifest(version) or (not store.marks(version).get("ids") and old.files.isEmpty())
    to = Setting(started, config.compat, commit, first, _ids(store, old, first))
    marks = store.marks(version)

    own = "root" if "root" in candidates.columns else "content"
    found = stage(candidates.select("path", "language", "size_bytes", "mtime_ns", own), "found")
    listed = source.listing(found)
    todo = changes.to_scan(found, old.files, marks.get("full_from", ""))
    scanned = stage(extract(todo, own == "root", module_path), "scanned")
    unread = scanned.filter("not is_read").select("path").unionByName(listed.join(found.select("path"), "path", "left_anti"))
    if mode == "full":
        deleted = m.deleted_files(old.files, listed)
    else:
        deleted = old.files.join(removed.select("path").distinct(), "path", "left_semi") if removed is not None else old.files.limit(0)
    is_new = F.col("changed")
    with ThreadPoolExecutor(3) as pool:
        of_scan = lambda: scanned.agg(F.count_if(is_new), F.count_if(~F.col("is_read")), F.count_if(F.col("is_read") & ~is_new & F.col("moved"))).first()
        seen, n_found, n_deleted = (x.result() for x in [pool.submit(f) for f in (of_scan, found.count, deleted.count)])
    n_changed, n_touched = seen[0], seen[2]
    scanned_files = n_found - seen[1]
    # an empty local table lets the optimizer drop what would follow from deletions
    deleted = stage(deleted.select("id", "path"), "deleted") if n_deleted else spark.createDataFrame([], "id bigint, path string")
    if quiet and version and not (n_changed or n_deleted or seen[1]):
        return RunResult(run, "success", mode, scanned_files, 0, 0, 0, 0, 0, 0)

    again, written, ids = 0, (0, 0, 0), dict(to.ids)
    with Draft(store, run) as draft:
        if n_changed or n_deleted or n_touched:
            work = changes.plan_files(scanned, n_changed, old, to, stage)
            draft.put("files", changes.file_changes(scanned, work, deleted, old, to))
            made = work.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_files", "n_packages", "n_symbols", "n_refs", "n_artifacts", "n_given")], F.count("known_id")).first()
            again, written = made[6], (made[5], made[3], made[4])
            ids |= {n: to.ids.get(n, 0) + made[k] for k, n in enumerate(COUNTED) if n != "diagnostics"}

        def diagnose() -> dict[str, int]:
            said, rows = changes.diagnostic_changes(scanned, unread, draft.frame("files"), deleted if n_deleted else None, old, run, to, stage)
            counts = {r[0]: r[1] for r in rows.groupBy("severity").count().collect()}  # one row a severity
            if counts or said.put is not None:
                draft.put("diagnostics", said)
            return counts

        says = draft.run(diagnose)
        if n_changed or n_deleted:
            _merge(draft, scanned, work, deleted, old, config, to, stage, made)
        elif config.summaries and not first and old.file_summaries.isEmpty():
            for n, df in summarised(old, config.summary_kinds).items():
                draft.put(n, df)
        counts = says.result()
        ids["diagnostics"] = to.ids.get("diagnostics", 0) + sum(counts.values())
        errors, warnings = counts.get("error", 0) + counts.get("fatal", 0), counts.get("warning", 0)
        status = "partial" if errors else "success"
        row = {
            "id": run, "started_at": started, "finished_at": _now(), "status": status, "mode": mode, "files_scanned": scanned_files, "files_changed": n_changed, "files_reparsed": again, "symbols_written": written[0],
            "references_written": written[1], "artifacts_written": written[2], "error_count": errors, "warning_count": warnings, "git_commit": commit or None,
        }
        draft.put("index_runs", Change(fresh=_run_row(spark, old, row), added=1))
        marks = {"ids": ids}
        if mode == "full":  # what was written before this moment has been read by this run or was known before
            marks["full_from"] = (began - datetime.timedelta(seconds=CLOCKS)).strftime("%Y-%m-%dT%H:%M:%SZ")
        draft.commit(marks)
    if strict and errors:
        raise _StrictError(f"{errors} errors while indexing")
    return RunResult(run, status, mode, scanned_files, n_changed, n_deleted, written[0], written[1], errors, warnings)


def _merge(draft: Draft, scanned: DataFrame, work: DataFrame, deleted: DataFrame, old: IndexTables, config: source.Config, to: Setting, stage, made) -> None:
    """Changes of all other tables; each is written as soon as it is known, summaries from the tables as they will be."""
    packages, links = changes.package_changes(work, deleted, old, to)
    draft.put("packages", replace(packages, added=made[1]))
    draft.put("package_files", links)
    fresh = changes.new_symbols(scanned, work, to, stage)
    gone = hits = files = None
    symbols = Change(fresh=fresh)
    if not to.first:
        known = work.filter("known_id is not null").select(F.col("known_id").alias("k"), F.lit(False).alias("is_deleted"))
        files = stage(known.unionByName(deleted.select(F.col("id").alias("k"), F.lit(True).alias("is_deleted"))), "reached")
        gone = changes.gone_symbols(old, files, fresh, stage)
        symbols = changes.symbol_changes(old, fresh, gone)
    draft.put("symbols", replace(symbols, added=made[2]))
    draft.put("artifacts", replace(changes.artifact_changes(scanned, work, old, files, gone, to), added=made[4]))
    if not to.first:
        names = gone.select("qualified_name").unionByName(fresh.select("qualified_name"))
        hits = changes.ref_hits(old, files, gone, names, stage)
    refs = changes.ref_changes(scanned, work, old, hits, fresh, draft.frame("symbols"), to, stage)
    draft.put("refs", replace(refs, added=made[3]))
    reached = None if to.first else stage(changes.reached_files(work, deleted, gone, refs), "reached_files")
    t = old.replace(**{n: draft.frame(n) for n in ("files", "packages", "package_files", "symbols", "refs", "artifacts")})
    kinds = config.summary_kinds if config.summaries else []
    if to.first or (kinds and old.file_summaries.isEmpty()):
        sizes = {"file_summaries": made[0], "symbol_summaries": made[2]}
        for n, df in changes.summarised(t, kinds).items():
            draft.put(n, Change(fresh=df, added=sizes.get(n, 0)) if to.first else df)
        return
    todo = {
        "symbol_summaries": draft.run(changes.symbol_summary_change, t, hits, gone, refs, symbols, "symbol" in kinds, stage),
        "package_summaries": draft.run(changes.package_summary_change, t, old, reached, deleted, "package" in kinds, stage),
        "file_summaries": draft.run(changes.file_summary_change, t, reached, deleted, "file" in kinds),
    }
    for n, change in todo.items():
        draft.put(n, change.result())
