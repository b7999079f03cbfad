"""Index maintenance as set operations: change detection, upserts, replacement by file, cascades, resolution."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.schema import FOREIGN_KEYS, TABLES, IndexTables


def changed_files(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose (path, content_hash) is not known."""
    return candidates.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def deleted_files(known: DataFrame, candidates: DataFrame) -> DataFrame:
    return known.join(candidates.select("path"), "path", "left_anti")


def last_by(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key in the given order; an aggregation, so a hot key is combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.max_by(row, F.struct(*order)).alias("__r")).select("__r.*")


def dedup_stable_ids(symbols: DataFrame) -> DataFrame:
    """Of symbols that share a stable id the one with the greatest id stays."""
    return last_by(symbols, ["stable_id"], F.col("id"))


def upsert_packages(rows: DataFrame) -> DataFrame:
    """One package for each directory: that of the greatest path."""
    return last_by(rows, ["directory_path"], F.col("path"))


def upsert_files(old: DataFrame, new: DataFrame, now: str, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """old with new rows by path; ids and created_at of known paths stay, new ids follow the greatest one in path order."""
    o = old.select("path", F.col("id").alias("old_id"), F.col("created_at").alias("old_created"))
    both = new.drop("id", "created_at").join(o, "path", "left")
    fresh = numbered(both.filter("old_id is null"), ["path"], stage, greatest(old))
    keep = both.filter("old_id is not null").withColumn("id", F.col("old_id"))
    rows = keep.unionByName(fresh, allowMissingColumns=True).withColumn("created_at", F.coalesce("old_created", F.lit(now))).withColumn("updated_at", F.lit(now))
    untouched = old.join(new.select("path"), "path", "left_anti")
    return untouched.select(*old.columns).unionByName(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in old.columns]))


def greatest(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def numbered(df: DataFrame, order: list[str], stage: Callable[[DataFrame, str], DataFrame], after: int = 0, name: str = "id") -> DataFrame:
    """df with consecutive numbers in the given order, and no single-partition sort.

    Rows are range-partitioned and sorted; each partition numbers its own rows, and a table of partition sizes gives
    the offsets. stage writes the rows once and reads them again, so that later plans all see the same numbers.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = stage(sorted_, "numbered").withColumn("__p", F.shiftright("__at", 33)).withColumn("__k", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return rows.join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__off") + F.col("__k") + 1 + after).cast("long")).drop("__at", "__p", "__k", "__off")


def link_files(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).dropDuplicates(["package_id", "file_id"])


def resolve(refs: DataFrame, symbols: DataFrame, compat: str = "reference") -> DataFrame:
    """Unresolved references with a target text get the symbol of that qualified name: the first by id.

    Mode "fixed" resolves only names that are unique.
    """
    first = symbols.groupBy("qualified_name").agg(F.min(F.struct("id", "file_id")).alias("s"), F.count("*").alias("n"))
    if compat == "fixed":
        first = first.filter("n = 1")
    first = first.select(F.col("qualified_name").alias("k"), F.col("s.id").alias("s_id"), F.col("s.file_id").alias("s_file"))
    open_ = ~F.coalesce("is_resolved", F.lit(False)) & F.col("raw_target_text").isNotNull()
    # rows that can't resolve get keys of their own, which no name has, so they don't land in one task
    key = F.when(open_, F.col("raw_target_text")).otherwise(F.concat(F.lit("\u0000"), F.col("id").cast("string")))
    rows = refs.withColumn("__k", key).join(first, F.col("__k") == F.col("k"), "left")
    hit = F.col("s_id").isNotNull()
    new = {"to_symbol_id": F.when(hit, F.col("s_id")).otherwise(F.col("to_symbol_id")), "to_file_id": F.when(hit, F.col("s_file")).otherwise(F.col("to_file_id")), "is_resolved": hit | F.coalesce("is_resolved", F.lit(False))}
    return rows.withColumns(new).select(*refs.columns)


def enclosing_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, from_symbol_id): the innermost symbol whose lines hold a reference's line, in the same file.

    Interval stabbing: symbols and references of a file are sorted by line once and swept with the symbols that are
    open at a line, so the work is linear in both (times the log of the open symbols), however deep they nest. Null
    lines and files, and symbols that end before they start, meet nothing; of equally long symbols the least id counts.
    """
    s = symbols.filter("file_id is not null and start_line <= end_line").select(F.col("file_id").alias("f"), F.col("start_line").alias("at"), F.lit(0).alias("what"), F.col("end_line").alias("last"), "id")
    r = refs.filter("from_file_id is not null and line is not null").select(F.col("from_file_id").alias("f"), F.col("line").alias("at"), F.lit(1).alias("what"), F.lit(None).cast("long").alias("last"), "id")
    events = s.unionByName(r).repartition("f").sortWithinPartitions("f", "at", "what")
    return events.mapInArrow(_stabbed, "id long, from_symbol_id long")


def _stabbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps events (file, line, 0 for a symbol or 1 for a reference, last line, id) in order."""
    file, open_ = None, []  # the shortest open symbol first; one that has ended goes when it comes to the front
    for b in batches:
        ids, inside = [], []
        for f, at, what, last, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if f != file:
                file, open_ = f, []
            if what == 0:
                heapq.heappush(open_, (last - at, i, last))
                continue
            while open_ and open_[0][2] < at:
                heapq.heappop(open_)
            if open_:
                ids.append(i)
                inside.append(open_[0][1])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(inside, pa.int64())], ["id", "from_symbol_id"])


def _without(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids, _own_key(rows, column) == F.col("k"), "left_anti")


def _own_key(rows: DataFrame, column: str) -> Column:
    """A foreign key column; nulls, which meet nothing, get keys of their own, so they don't land in one task."""
    return F.coalesce(F.col(column), -1 - F.abs(F.col("id"))) if column != "id" and "id" in rows.columns else F.col(column)


def _cut(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows with null in a column where it is one of ids."""
    met = rows.join(ids.select(F.col("k").alias("__k")), _own_key(rows, column) == F.col("__k"), "left")
    return met.withColumn(column, F.when(F.col("__k").isNull(), F.col(column))).select(*rows.columns)


#: Tables that others point to, those that follow from others last.
PARENTS = ("index_runs", "packages", "files", "symbols")


def spread(t: IndexTables, own: dict[str, tuple[str, DataFrame]]) -> IndexTables:
    """t without the rows of own (table -> column and its values k), all foreign keys followed: deletions, then nulls.

    Semi-naive: the ids that go are found once for each table that others point to, from the ids of its own parents
    alone; then every table is filtered once by the ids that its columns meet.
    """
    gone: dict[str, DataFrame] = {}
    for p in PARENTS:
        rows, parts = getattr(t, p), []
        if p in own:
            column, ids = own[p]
            parts.append(ids if column == "id" else rows.join(ids, F.col(column) == F.col("k"), "left_semi").select(F.col("id").alias("k")))
        parts += [rows.join(gone[up], F.col(c) == F.col("k"), "left_semi").select(F.col("id").alias("k")) for child, c, up, _, how in FOREIGN_KEYS if child == p and how == "cascade" and up in gone and up != p]
        if parts:
            gone[p] = functools.reduce(DataFrame.unionByName, parts).distinct() if len(parts) > 1 else parts[0]
    out = {}
    for name in TABLES:
        rows = df = getattr(t, name)
        if name in own:
            df = _without(df, own[name][0], own[name][1])
        edges = [(c, gone[up], how) for child, c, up, _, how in FOREIGN_KEYS if child == name and up in gone]
        for c, ids, how in sorted(edges, key=lambda e: e[2] != "cascade"):
            df = _without(df, c, ids) if how == "cascade" else _cut(df, c, ids)
        if df is not rows:
            out[name] = df
    return t.replace(**out)


def cascade(t: IndexTables, parent: str, gone: DataFrame) -> IndexTables:
    """t without the parent's rows of the given ids (column k), all foreign keys followed: deletions first, then nulls."""
    return spread(t, {parent: ("id", gone.select("k").distinct())})


def invalidate(t: IndexTables, changed: DataFrame) -> IndexTables:
    """Prepares changed files (column k) for new rows: their symbols, references and summaries go, incoming references open."""
    ids = changed.select("k").distinct()
    packages = t.package_files.join(ids, F.col("file_id") == F.col("k"), "left_semi").select("package_id").distinct()
    t = spread(t, {"symbols": ("file_id", ids), "refs": ("from_file_id", ids), "artifacts": ("file_id", ids), "file_summaries": ("file_id", ids)})
    m = ids.select(F.col("k").alias("__k"))
    met = t.refs.join(m, _own_key(t.refs, "to_file_id") == F.col("__k"), "left")
    opened = met.withColumn("is_resolved", F.when(F.col("__k").isNotNull() & F.col("to_symbol_id").isNull(), F.lit(False)).otherwise(F.col("is_resolved"))).select(*t.refs.columns)
    return t.replace(refs=opened, package_summaries=t.package_summaries.join(packages, "package_id", "left_anti").select(*t.package_summaries.columns))


def satisfied_interfaces(methods: DataFrame, required: DataFrame) -> DataFrame:
    """(file_id, type_name, interface_name) where a type's methods hold all that an interface of its file requires.

    methods: file_id, type_name, method; required: file_id, interface_name, method. Counts shared methods with an
    equi-join on file and method, so types meet only the interfaces they share a method with.
    """
    need = required.distinct()
    n = need.groupBy("file_id", "interface_name").agg(F.count("*").alias("n"))
    shared = methods.distinct().join(need, ["file_id", "method"]).groupBy("file_id", "type_name", "interface_name").agg(F.count("*").alias("m"))
    return shared.join(n, ["file_id", "interface_name"]).filter("m = n").select("file_id", "type_name", "interface_name")


def nearest_preceding(points: DataFrame, marks: DataFrame, key: str = "file_id", at: str = "line", value: str = "value") -> DataFrame:
    """points with the value of the last mark at or before them: one sort of the union, no range join."""
    p = points.withColumn("__point", F.lit(1)).withColumn("__v", F.lit(None).cast(marks.schema[value].dataType))
    m = marks.select(key, at, F.lit(0).alias("__point"), F.col(value).alias("__v"))
    w = W.partitionBy(key).orderBy(at, "__point").rowsBetween(W.unboundedPreceding, W.currentRow)
    return p.unionByName(m, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__point = 1").drop("__point").withColumnRenamed("__v", value)
