"""Health checks of a store, and the validation checks that need the file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import report
from lodestar.plans.store import Store
from lodestar.schema import TABLES, IndexTables
from lodestar.sources.files import Config, on_disk, walk


def files_on_disk(t: IndexTables, root: str) -> int:
    """Indexed files that are gone: an anti join with the listing of the tree."""
    return t.files.select("path").join(on_disk(t.files.sparkSession, root), "path", "left_anti").count()


def unindexed_files(t: IndexTables, candidates: DataFrame) -> DataFrame:
    return candidates.select("path").join(t.files.select("path"), "path", "left_anti")


def validate(spark: SparkSession, t: IndexTables, root: str, config: Config = Config(), strict: bool = False) -> tuple[list[dict], bool]:
    checks = [r.asDict() for r in report.validation_report(t).collect()]
    missing = files_on_disk(t, root)
    checks.append({"name": "files_on_disk", "status": "fail" if missing else "pass", "violations": missing})
    if strict:
        n = unindexed_files(t, walk(spark, root, config)).count()
        checks.append({"name": "unindexed_files", "status": "fail" if n else "pass", "violations": n})
    return checks, all(c["status"] != "fail" for c in checks)


def doctor(spark: SparkSession, store: Store, root: str) -> tuple[list[dict], bool]:
    """Eight checks; where the store can't be opened only the first three run."""
    out: list[dict] = []

    def check(name: str, ok: bool, details: str = "", warn: bool = False) -> bool:
        out.append({"name": name, "status": "pass" if ok else "warn" if warn else "fail", "details": details})
        return ok

    there = check("storage_directory", store.fs.exists(store._p(store.path)), store.path)
    try:
        version = store.version() if there else 0
        opened = check("database", there and version > 0, f"snapshot {version}")
    except Exception as e:  # noqa: BLE001
        opened = check("database", False, str(e))
    try:
        store.check_version()
        check("schema_version", there)
    except RuntimeError as e:
        opened = check("schema_version", False, str(e)) and opened
    if not opened:
        return out, False
    t = store.load()
    last = report.last_run(t).first()
    check("latest_run", last is not None and last["status"] != "failed", last["status"] if last else "no run", warn=True)
    stale = report.stale_all(t).count()
    check("stale_summaries", stale == 0, f"{stale} stale", warn=True)
    missing = files_on_disk(t, root)
    check("missing_files", missing == 0, f"{missing} missing", warn=True)
    whole = True
    for n in TABLES:  # every table's footers and rows can be read under the declared schema
        try:
            getattr(t, n).agg(F.count(F.struct("*"))).first()
        except Exception:  # noqa: BLE001
            whole = False
    check("integrity", whole)
    check("manifest", store._read("_schema.json") is not None)
    return out, all(c["status"] != "fail" for c in out)
