"""What a run changes, as small tables: which rows go, which are replaced, which are new.

Everything follows from the files that changed or went. Keys spread along the foreign keys once for each table
(semi-naive: only what the last step added is followed), references are resolved again only where a name came, went
or where they are new or reopened, and summaries are made again only for what a change reaches. Nothing here reads a
table more than a few times or writes what stays as it is; the store writes the buckets that the changes touch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.compat import generated_flag, rfc3339
from lodestar.operators import maintain as m
from lodestar.plans import summaries
from lodestar.plans.store import Change
from lodestar.schema import EXTENDED_SYMBOL_KINDS, SYMBOL_KINDS, IndexTables
from lodestar.sources.tree import mtime

Stage = Callable[[DataFrame, str], DataFrame]
#: Up to so many changed files are numbered by one task; they are one light row each.
ONE_TASK = 50_000
#: What ids are given to.
COUNTED = ("files", "packages", "symbols", "refs", "artifacts", "diagnostics")


@dataclass(frozen=True)
class Setting:
    """What a run knows from the start."""

    now: str
    compat: str
    commit: str
    first: bool  # whether the index is empty
    ids: dict[str, int]  # the greatest id given so far

    @property
    def kinds(self) -> list[str]:
        return EXTENDED_SYMBOL_KINDS if self.compat == "fixed" else SYMBOL_KINDS


def modified_utc(ns: Column) -> Column:
    return rfc3339(mtime(ns))


def legal(symbols: Column, kinds: list[str]) -> Column:
    """How many symbols come before the first one of an illegal kind, which ends its file's insertions."""
    bad = F.array_position(F.transform(symbols, lambda s: F.coalesce(s["symbol_kind"].isin(kinds), F.lit(False))), False)
    return F.when(bad > 0, bad - 1).otherwise(F.size(symbols)).cast("long")


def to_scan(listed: DataFrame, known: DataFrame, cutoff: str) -> DataFrame:
    """Listed files that may differ from what is known, with the known hash, and whether the known time is another (moved).

    A file of the known size and time is left alone if that time lies before the last full scan; a later one may have
    been written again within the same second.
    """
    k = known.select("path", F.col("content_hash").alias("known_hash"), F.col("size_bytes").alias("k_size"), F.col("last_modified_utc").alias("k_time"))
    same = (F.col("k_size") == F.col("size_bytes")) & (F.col("k_time") == modified_utc(F.col("mtime_ns"))) & (F.col("k_time") < cutoff)
    return listed.join(k, "path", "left").filter(~F.coalesce(same, F.lit(False))).withColumn("moved", F.col("k_time") != modified_utc(F.col("mtime_ns"))).drop("k_size", "k_time")


def plan_files(scanned: DataFrame, n_changed: int, old: IndexTables, to: Setting, stage: Stage) -> DataFrame:
    """One row for each changed file: its id, its package, and where its rows start among all new ones of each table.

    Files are sorted by path and every table's rows are numbered in that order: sums within partitions and a table of
    partition totals give all starts at once.
    """
    c = scanned.filter("changed").select(
        "path", "language", "size_bytes", "mtime_ns", "content_hash", generated_flag(F.col("path"), F.col("head")).alias("is_generated"), "parse_status", "package",
        legal(F.col("symbols"), to.kinds).alias("n_symbols"), F.size("symbols").alias("n_given"), F.size("refs").cast("long").alias("n_refs"), F.size("artifacts").cast("long").alias("n_artifacts"),
    )
    c = c.join(old.files.select("path", F.col("id").alias("known_id"), F.col("created_at").alias("known_created")), "path", "left")
    # of the changed files of a directory the one of the greatest path gives its package's name, import path and language
    c = c.withColumn("directory_path", F.when(F.col("package.name").isNotNull(), F.col("package.directory_path")))
    speaker = c.filter("directory_path is not null").groupBy(F.col("directory_path").alias("d")).agg(F.max("path").alias("speaker"))
    home = old.packages.select(F.col("directory_path").alias("h"), F.col("id").alias("old_package"), F.col("created_at").alias("package_created"))
    c = c.join(speaker, F.col("directory_path") == F.col("d"), "left").join(home, F.col("directory_path") == F.col("h"), "left").drop("d", "h")
    c = c.withColumn("speaks", F.coalesce(F.col("speaker") == F.col("path"), F.lit(False)))
    c = c.withColumn("n_files", F.col("known_id").isNull().cast("long")).withColumn("n_packages", (F.col("speaks") & F.col("old_package").isNull()).cast("long"))
    counted = [n for n in COUNTED if n != "diagnostics"]
    before = W.orderBy("q").rowsBetween(W.unboundedPreceding, -1)
    if n_changed <= ONE_TASK:
        alone = W.partitionBy(F.lit(0)).orderBy("path").rowsBetween(W.unboundedPreceding, -1)
        rows = c.withColumns({f"s_{n}": F.coalesce(F.sum(f"n_{n}").over(alone), F.lit(0)) + to.ids.get(n, 0) for n in counted})
    else:
        rows = c.repartitionByRange("path").sortWithinPartitions("path").withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
        rows = stage(rows, "changed")
        here = W.partitionBy("p").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
        total = rows.groupBy(F.col("p").alias("q")).agg(*[F.sum(f"n_{n}").alias(n) for n in counted])  # one row a partition
        starts = total.select("q", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"o_{n}") for n in counted])
        start = {n: F.coalesce(F.sum(f"n_{n}").over(here), F.lit(0)) + F.col(f"o_{n}") + to.ids.get(n, 0) for n in counted}
        rows = rows.join(F.broadcast(starts), F.col("p") == F.col("q")).withColumns({f"s_{n}": v for n, v in start.items()}).drop("p", "at", "q")
    rows = rows.withColumn("file_id", F.coalesce("known_id", F.col("s_files") + 1))
    rows = rows.withColumn("own_package", F.when(F.col("speaks"), F.coalesce("old_package", F.col("s_packages") + 1)))
    # the package of a directory is the one of its speaker
    package = F.when(F.col("directory_path").isNotNull(), F.max("own_package").over(W.partitionBy(F.coalesce("directory_path", F.concat(F.lit("\0"), "path")))))
    return stage(rows.withColumn("package_id", package), "work")


def _blank(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c)).alias(c)


def _zero(c: str) -> Column:
    return F.when(F.col(c) != 0, F.col(c)).alias(c)


def _none(c: str, kind: str = "long") -> Column:
    return F.lit(None).cast(kind).alias(c)


def _cut(c: str, gone: str) -> Column:
    """Column c, null where the key that met it is there."""
    return F.when(F.col(gone).isNull(), F.col(c)).alias(c)


def _met(rows: DataFrame, keys: DataFrame, column: str, name: str, tie: str = "id") -> DataFrame:
    """rows with a column `name`, the key that their column meets; null keys lie under keys of their own."""
    return rows.join(keys.select(F.col("k").alias(name)), F.coalesce(F.col(column), -1 - F.abs(F.col(tie))) == F.col(name), "left")


def file_changes(scanned: DataFrame, work: DataFrame, deleted: DataFrame, old: IndexTables, to: Setting) -> Change:
    """Changed and new files; of others that were read only the time."""
    head = work.select(
        F.col("file_id").alias("id"), "path", "language", F.col("package.name").alias("package_name"), F.when(F.coalesce("package.import_path", F.lit("")) != "", F.col("package.import_path")).alias("module_name"), "content_hash", "size_bytes",
        modified_utc(F.col("mtime_ns")).alias("last_modified_utc"), F.lit(to.commit or None).cast("string").alias("git_commit"), "is_generated", "parse_status", F.coalesce("known_created", F.lit(to.now)).alias("created_at"), F.lit(to.now).alias("updated_at"), "known_id",
    )
    fresh = head.filter("known_id is null").drop("known_id")
    if to.first:
        return Change(fresh=fresh)
    touched = scanned.filter("is_read and not changed and moved").select(F.col("path").alias("t_path"), modified_utc(F.col("mtime_ns")).alias("t_time"))
    again = old.files.join(touched, F.col("path") == F.col("t_path")).withColumn("last_modified_utc", F.col("t_time"))
    return Change(deleted.select("id"), head.filter("known_id is not null").drop("known_id").unionByName(again.select(*old.files.columns)), fresh)


def package_changes(work: DataFrame, deleted: DataFrame, old: IndexTables, to: Setting) -> tuple[Change, Change]:
    """Packages by directory, and which files they hold."""
    rows = work.filter("speaks").select(
        F.col("own_package").alias("id"), F.col("package.name").alias("name"), F.when(F.col("package.import_path") != "", F.col("package.import_path")).alias("import_path"), "directory_path", F.col("package.language").alias("language"),
        F.coalesce("package_created", F.lit(to.now)).alias("created_at"), F.lit(to.now).alias("updated_at"), "old_package",
    )
    new = rows.filter("old_package is null").drop("old_package")
    links = work.filter("package_id is not null").select("package_id", "file_id")
    if to.first:
        return Change(fresh=new), Change(fresh=links)
    out = old.package_files.join(deleted.select(F.col("id").alias("k")), F.col("file_id") == F.col("k"), "left_semi")
    return Change(put=rows.filter("old_package is not null").drop("old_package"), fresh=new), Change(out, links)


def new_symbols(scanned: DataFrame, work: DataFrame, to: Setting, stage: Stage) -> DataFrame:
    """Symbols of changed files. Of those that share a stable id the one with the greatest id stays; parents that went are cut."""
    w = work.select("path", "file_id", "package_id", "s_symbols", "n_symbols")
    s = scanned.filter("changed").select("path", "symbols").join(w, "path").select("file_id", "package_id", "s_symbols", F.posexplode(F.slice("symbols", F.lit(1), F.col("n_symbols").cast("int"))).alias("ordinal", "s"))
    s = s.select("file_id", "package_id", (F.col("s_symbols") + F.col("ordinal") + 1).alias("id"), (F.col("s_symbols") + F.col("s.parent_at") + 1).alias("parent_symbol_id"), "s.*")
    s = s.withColumn("top", F.max("id").over(W.partitionBy("stable_id")))
    s = stage(s.select("id", "file_id", "package_id", "name", "qualified_name", "symbol_kind", "visibility", "parent_symbol_id", _blank("signature"), _blank("doc_comment"), _zero("start_line"), _zero("end_line"), "stable_id", F.lit(to.now).alias("created_at"), F.lit(to.now).alias("updated_at"), "top"), "new_symbols")
    lost = s.filter("id < top").select(F.col("id").alias("k"))
    rows = _met(s.filter("id = top").drop("top"), lost, "parent_symbol_id", "lost")
    return rows.select(*[_cut(c, "lost") if c == "parent_symbol_id" else F.col(c) for c in s.columns if c != "top"])


def gone_symbols(old: IndexTables, files: DataFrame, fresh: DataFrame, stage: Stage) -> DataFrame:
    """Symbols of files that changed or went, and others whose stable id a new symbol has: (id, file_id, qualified_name)."""
    taken = fresh.select(F.col("stable_id").alias("taken")).distinct()
    rows = old.symbols.join(files.select(F.col("k").alias("of_file")), F.col("file_id") == F.col("of_file"), "left").join(taken, F.col("stable_id") == F.col("taken"), "left")
    return stage(rows.filter("of_file is not null or taken is not null").select("id", "file_id", "qualified_name"), "gone_symbols")


def symbol_changes(old: IndexTables, fresh: DataFrame, gone: DataFrame) -> Change:
    children = old.symbols.filter("parent_symbol_id is not null").join(gone.select(F.col("id").alias("k")), F.col("parent_symbol_id") == F.col("k"), "left_semi")
    children = children.join(gone.select("id"), "id", "left_anti").withColumn("parent_symbol_id", F.lit(None).cast("long"))
    return Change(gone, children.select(*old.symbols.columns), fresh)


def ref_hits(old: IndexTables, files: DataFrame, gone: DataFrame, names: DataFrame, stage: Stage) -> DataFrame:
    """References that a change reaches, with what reached them: their own file or symbol, a target, or a name that came or went."""
    k = gone.select(F.col("id").alias("k"))
    rows = _met(_met(old.refs, files, "from_file_id", "own_file"), k, "from_symbol_id", "own_symbol")
    rows = _met(rows, k, "to_symbol_id", "target")
    ends = files.select(F.col("k").alias("target_file"), "is_deleted")
    rows = rows.join(ends, F.coalesce("to_file_id", -1 - F.abs(F.col("id"))) == F.col("target_file"), "left")
    # a name that no reference has in place of those that can't resolve, so that they don't meet in one task
    open_ = ~F.coalesce("is_resolved", F.lit(False)) & F.col("raw_target_text").isNotNull()
    rows = rows.withColumn("wanted", F.when(open_, F.col("raw_target_text")).otherwise(F.concat(F.lit("\0"), F.col("id").cast("string"))))
    rows = rows.join(names.select(F.col("qualified_name").alias("met_name")).distinct(), F.col("wanted") == F.col("met_name"), "left").drop("wanted")
    return stage(rows.filter("coalesce(own_file, own_symbol, target, target_file) is not null or met_name is not null"), "ref_hits")


def ref_changes(scanned: DataFrame, work: DataFrame, old: IndexTables, hits: DataFrame | None, fresh_symbols: DataFrame, symbols: DataFrame, to: Setting, stage: Stage) -> Change:
    """References: those of changed files anew, targets that went cut, open ones resolved where a name came, went or is new.

    symbols is the table after the run. A changed file's incoming references open again; a deleted file's stay resolved.
    """
    w = work.select("path", F.col("file_id").alias("from_file_id"), "s_refs")
    r = scanned.filter("changed").select("path", "refs").join(w, "path").select("from_file_id", "s_refs", F.posexplode("refs").alias("ordinal", "r"))
    r = r.select("from_file_id", (F.col("s_refs") + F.col("ordinal") + 1).alias("id"), "r.reference_kind", "r.confidence", "r.line", "r.raw_target_text")
    new = r.select("id", _none("from_symbol_id"), _none("to_symbol_id"), "from_file_id", _none("to_file_id"), "reference_kind", "confidence", _zero("line"), _none("column_start"), _none("column_end"), _blank("raw_target_text"), F.lit(False).alias("is_resolved"), F.lit(to.now).alias("created_at"))
    if to.compat == "fixed":
        new = stage(new, "new_refs")
        inner = m.enclosing_symbols(new, fresh_symbols).withColumnsRenamed({"id": "e_id", "from_symbol_id": "e_symbol"})
        new = new.join(inner, F.col("id") == F.col("e_id"), "left").withColumn("from_symbol_id", F.col("e_symbol")).select(*old.refs.columns)
    open_ = new.withColumn("is_new", F.lit(True))
    gone = None
    if hits is not None:
        gone = hits.filter("own_file is not null or own_symbol is not null")
        left = hits.filter("own_file is null and own_symbol is null").withColumn("to_symbol_id", _cut("to_symbol_id", "target"))
        reopened = F.col("target_file").isNotNull() & ~F.col("is_deleted") & F.col("to_symbol_id").isNull()
        left = left.withColumn("is_resolved", F.when(reopened, F.lit(False)).otherwise(F.col("is_resolved")))
        left = left.withColumn("to_file_id", F.when(F.coalesce("is_deleted", F.lit(False)), F.lit(None).cast("long")).otherwise(F.col("to_file_id")))
        open_ = open_.unionByName(left.select(*old.refs.columns, F.lit(False).alias("is_new")))
        wanted = open_.filter("not coalesce(is_resolved, false)").select(F.col("raw_target_text").alias("qualified_name")).distinct()
        symbols = symbols.join(wanted, "qualified_name", "left_semi")
    solved = stage(m.resolve(open_, symbols, to.compat), "refs")
    return Change(gone, None if hits is None else solved.filter("not is_new").drop("is_new"), solved.filter("is_new").drop("is_new"))


def artifact_changes(scanned: DataFrame, work: DataFrame, old: IndexTables, files: DataFrame, gone: DataFrame | None, to: Setting) -> Change:
    w = work.select("path", "file_id", "s_artifacts")
    a = scanned.filter("changed").select("path", "artifacts").join(w, "path").select("file_id", "s_artifacts", F.posexplode("artifacts").alias("ordinal", "a"))
    a = a.select("file_id", (F.col("s_artifacts") + F.col("ordinal") + 1).alias("id"), "a.*")
    new = a.select("id", "artifact_kind", "name", "file_id", _none("symbol_id"), "data_json", "confidence", F.lit(to.now).alias("created_at"), F.lit(to.now).alias("updated_at"))
    if gone is None:
        return Change(fresh=new)
    out = old.artifacts.join(files, F.col("file_id") == F.col("k"), "left_semi")
    cut = old.artifacts.filter("symbol_id is not null").join(gone.select(F.col("id").alias("k")), F.col("symbol_id") == F.col("k"), "left_semi").join(files, F.col("file_id") == F.col("k"), "left_anti")
    return Change(out, cut.withColumn("symbol_id", F.lit(None).cast("long")).select(*old.artifacts.columns), new)


def diagnostic_changes(scanned: DataFrame, unread: DataFrame, files: DataFrame, deleted: DataFrame | None, old: IndexTables, run: int, to: Setting, stage: Stage) -> tuple[Change, DataFrame]:
    """New diagnostics of a run; a deleted file's old ones lose it. Also returns the new rows."""
    d = scanned.select("path", F.explode("diagnostics").alias("d")).select("path", "d.*")
    bad = scanned.filter(F.col("changed") & (legal(F.col("symbols"), to.kinds) < F.size("symbols"))).select("path", F.lit("error").alias("severity"), F.lit("PARSE_ERROR").alias("code"), F.lit("illegal symbol kind").alias("message"))
    lost = unread.select("path", F.lit("error").alias("severity"), F.lit("FILE_MISSING").alias("code"), F.concat(F.lit("cannot read file "), "path").alias("message"))
    said = stage(d.unionByName(bad).unionByName(lost), "said")
    if said.isEmpty():
        rows = said.withColumn("id", F.lit(0).cast("long")).withColumn("file_id", F.lit(None).cast("long"))
    else:
        rows = m.numbered(said.join(files.select("path", F.col("id").alias("file_id")), "path", "left"), ["path", "code", "message"], stage, to.ids.get("diagnostics", 0))
    rows = rows.withColumn("run_id", F.lit(run).cast("long")).withColumn("created_at", F.lit(to.now))
    rows = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in old.diagnostics.schema.fields])
    cut = None
    if deleted is not None:
        cut = old.diagnostics.join(deleted.select(F.col("id").alias("k")), F.col("file_id") == F.col("k"), "left_semi").withColumn("file_id", F.lit(None).cast("long"))
    return Change(put=cut, fresh=rows), rows


def _clean(t: IndexTables) -> IndexTables:
    """t with the symbols of cleanly parsed files only."""
    ok = t.files.filter("parse_status = 'ok'").select(F.col("id").alias("k"))
    return t.replace(symbols=t.symbols.join(ok, F.col("file_id") == F.col("k"), "left_semi").select(*t.symbols.columns))


def summarised(t: IndexTables, kinds: list[str]) -> dict[str, DataFrame]:
    """The summary tables of the given kinds, made anew; symbols of files without a clean parse have none."""
    make = {"file": lambda: summaries.file_summaries(t), "package": lambda: summaries.package_summaries(t), "symbol": lambda: summaries.symbol_summaries(_clean(t))}
    return {f"{k}_summaries": make[k]() for k in kinds}


def _restricted(t: IndexTables, files: DataFrame) -> IndexTables:
    """t with the rows of some files (k)."""
    of = lambda df, c: df.join(files, F.col(c) == F.col("k"), "left_semi")
    return t.replace(files=of(t.files, "id"), symbols=of(t.symbols, "file_id"), refs=of(t.refs, "from_file_id"), artifacts=of(t.artifacts, "file_id"))


def reached_files(work: DataFrame, deleted: DataFrame, gone: DataFrame, refs: Change) -> DataFrame:
    """Files (k) some of whose rows changed."""
    k = lambda df, c: df.select(F.col(c).alias("k"))
    return k(work, "file_id").unionByName(k(gone, "file_id")).unionByName(k(refs.gone, "from_file_id")).distinct().join(k(deleted, "id"), "k", "left_anti")


def file_summary_change(t: IndexTables, files: DataFrame, deleted: DataFrame, on: bool) -> Change:
    """Summaries of reached files, made again from t, the tables after the run; those of deleted files go."""
    lost = files.unionByName(deleted.select(F.col("id").alias("k"))).select(F.col("k").alias("file_id"))
    return Change(lost, fresh=summaries.file_summaries(_restricted(t, files)) if on else None)


def package_summary_change(t: IndexTables, old: IndexTables, files: DataFrame, deleted: DataFrame, on: bool, stage: Stage) -> Change:
    """Summaries of packages one of whose files was reached or went."""
    ids = files.unionByName(deleted.select(F.col("id").alias("k"))) if on else files
    held = t.package_files.unionByName(old.package_files).join(ids, F.col("file_id") == F.col("k"), "left_semi")
    packages = stage(held.select(F.col("package_id").alias("k")).distinct(), "reached_packages")
    fresh = None
    if on:
        of_packages = t.package_files.join(packages, F.col("package_id") == F.col("k"), "left_semi")
        fresh = summaries.package_summaries(t.replace(packages=t.packages.join(packages, F.col("id") == F.col("k"), "left_semi"), package_files=of_packages))
    return Change(packages.select(F.col("k").alias("package_id")), fresh=fresh)


def symbol_summary_change(t: IndexTables, hits: DataFrame, gone: DataFrame, refs: Change, symbols: Change, on: bool, stage: Stage) -> Change:
    """Summaries of symbols that are new or at an end of a reference that came, went or got another target."""
    lost = gone.select(F.col("id").alias("k"))
    if not on:
        return Change(lost.select(F.col("k").alias("symbol_id")))
    ends = [x.select(F.explode(F.array("from_symbol_id", "to_symbol_id")).alias("k")) for x in (hits, refs.put, refs.fresh)]
    reached = symbols.fresh.select(F.col("id").alias("k"))
    for e in ends:
        reached = reached.unionByName(e.filter("k is not null"))
    reached = stage(reached.distinct().join(lost, "k", "left_anti"), "reached_symbols")
    return Change(lost.unionByName(reached).select(F.col("k").alias("symbol_id")), fresh=summaries.symbol_summaries(_clean(t), reached))
