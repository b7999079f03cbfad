"""Search: symbols with ranking, files, packages, artifacts, relationships, diagnostics, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.compat import contains, included, like
from lodestar.schema import IndexTables

# Rank of a symbol kind; unknown kinds rank first.
KIND_RANK = {
    "function": 0, "method": 0, "struct": 1, "interface": 1, "type": 1, "class": 1, "entrypoint": 1, "trait": 1, "protocol": 1,
    "test": 2, "benchmark": 2, "package": 3, "module": 3, "enum": 3, "const": 4, "var": 4, "field": 5,
}
MATCHES = ["exact_qualified", "exact_stable_id", "exact_name", "fuzzy"]


def find_symbol(t: IndexTables, name: str, fuzzy: bool = False, kind: str = "", visibility: str = "", package: str = "", file: str = "", language: str = "", compat: str = "reference") -> DataFrame:
    """Symbols by qualified name, stable id, name and, if fuzzy, part of a name; the first that fits gives match_type.

    One scan serves all four steps. In the compatible mode the filters of the fuzzy step bind only to the
    qualified-name half of its OR; mode "fixed" applies them to both. Ordered by match, visibility, kind, recency, id.
    """
    s = t.symbols.alias("s").join(t.files.select(F.col("id").alias("f_id"), F.col("path").alias("file_path"), "language", F.col("updated_at").alias("file_updated_at")), F.col("file_id") == F.col("f_id"))
    keep = F.lit(True)
    if kind:
        keep &= F.col("symbol_kind") == kind
    if visibility:
        keep &= F.col("visibility") == visibility
    if file:
        keep &= contains(F.col("file_path"), file)
    if language:
        keep &= F.col("language") == language
    if package:
        ids = t.packages.filter((F.col("name") == package) | (F.col("import_path") == package)).select(F.col("id").alias("p_id")).distinct()
        s = s.join(ids, F.col("package_id") == F.col("p_id"), "left")
        keep &= F.col("p_id").isNotNull()
    pattern = f"%{name}%"
    by_name, by_qualified = like(F.col("s.name"), pattern), like(F.col("qualified_name"), pattern)
    steps = [(F.col("qualified_name") == name) & keep, (F.col("stable_id") == name) & keep, (F.col("s.name") == name) & keep]
    if fuzzy:
        steps.append(by_name | (by_qualified & keep) if compat == "reference" else (by_name | by_qualified) & keep)
    rank = F.lit(None).cast("int")
    for i, hit in reversed(list(enumerate(steps))):
        rank = F.when(hit, F.lit(i)).otherwise(rank)
    kinds = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])
    found = s.withColumn("match_rank", rank).filter("match_rank is not null")
    ordered = found.orderBy("match_rank", F.when(F.col("visibility") == "exported", 0).otherwise(1), F.coalesce(F.element_at(kinds, F.col("symbol_kind")), F.lit(0)), F.desc("file_updated_at"), F.col("s.id"))
    return ordered.select(
        F.col("s.id").alias("id"), "file_id", "package_id", F.col("s.name").alias("name"), "qualified_name", "symbol_kind", "visibility",
        F.coalesce("signature", F.lit("")).alias("signature"), F.coalesce("doc_comment", F.lit("")).alias("doc_comment"), "start_line", "end_line", "stable_id", "file_path",
        F.element_at(F.array(*map(F.lit, MATCHES)), F.col("match_rank") + 1).alias("match_type"),
    )


def find_file(t: IndexTables, pattern: str, exact: bool = False, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    hit = F.col("path") == pattern if exact else contains(F.col("path"), pattern)
    rows = t.files.filter(hit & included(F.col("path"), include or [], exclude or []))
    return rows.select("id", "path", "language", F.coalesce("package_name", F.lit("")).alias("package_name"), "content_hash", "size_bytes", "is_generated", "parse_status").orderBy("path")


def list_packages(t: IndexTables) -> DataFrame:
    """All packages with the counts of their files and symbols, each pre-aggregated once."""
    n_files = t.package_files.groupBy("package_id").agg(F.count("*").alias("file_count"))
    n_symbols = t.symbols.filter("package_id is not null").groupBy("package_id").agg(F.count("*").alias("symbol_count"))
    p = t.packages.join(n_files.withColumnRenamed("package_id", "k1"), F.col("id") == F.col("k1"), "left").join(n_symbols.withColumnRenamed("package_id", "k2"), F.col("id") == F.col("k2"), "left")
    zero = F.lit(0)
    return p.select("id", "name", F.coalesce("import_path", F.lit("")).alias("import_path"), "directory_path", "language", F.coalesce("file_count", zero).alias("file_count"), F.coalesce("symbol_count", zero).alias("symbol_count")).orderBy("name")


def find_package(t: IndexTables, name: str) -> DataFrame:
    return list_packages(t.replace(packages=t.packages.filter((F.col("name") == name) | (F.col("import_path") == name))))


def artifacts_of(t: IndexTables, kind: str, pattern: str | None = None) -> DataFrame:
    """Artifacts of a kind with their file and symbol; pattern is a part of the name."""
    a = t.artifacts.filter(F.col("artifact_kind") == kind)
    if pattern is not None:
        a = a.filter(contains(F.col("name"), pattern))
    f = t.files.select(F.col("id").alias("f_id"), F.col("path").alias("file_path"))
    s = t.symbols.select(F.col("id").alias("s_id"), F.col("qualified_name").alias("symbol_name"))
    rows = a.join(f, F.col("file_id") == F.col("f_id")).join(s, F.col("symbol_id") == F.col("s_id"), "left")
    return rows.select("id", "artifact_kind", "name", "file_path", F.coalesce("symbol_name", F.lit("")).alias("symbol_name"), "data_json", "confidence").orderBy("name", "file_path", "id")


# What each listing shows.
LISTINGS = {"routes": "route", "jobs": "background_job", "migrations": "migration", "integrations": "external_service", "entrypoints": "cli_command"}


def list_artifacts(t: IndexTables, what: str, compat: str = "reference") -> DataFrame:
    if what == "entrypoints" and compat == "fixed":
        s = t.symbols.filter("symbol_kind = 'entrypoint'").join(t.files.select(F.col("id").alias("f_id"), F.col("path").alias("file_path")), F.col("file_id") == F.col("f_id"))
        return s.select("id", F.lit("entrypoint").alias("artifact_kind"), "name", "file_path", F.col("qualified_name").alias("symbol_name"), F.lit("{}").alias("data_json"), F.lit("exact").alias("confidence"))
    return artifacts_of(t, LISTINGS[what])


def _with_ends(t: IndexTables, refs: DataFrame) -> DataFrame:
    s = t.symbols.select("id", "qualified_name")
    f = t.files.select("id", "path")
    side = lambda df, key, val: df.select(F.col("id").alias(key), F.col("qualified_name" if "qualified_name" in df.columns else "path").alias(val))
    # a null key meets nothing; under a key of its own (ids are positive) it does not land in one task with all others
    spread = lambda c: F.coalesce(F.col(c), -1 - F.abs(F.col("id")))
    rows = (
        refs.join(side(f, "k_ff", "from_file"), F.col("from_file_id") == F.col("k_ff"))
        .join(side(s, "k_fs", "from_symbol"), spread("from_symbol_id") == F.col("k_fs"), "left")
        .join(side(s, "k_ts", "to_symbol"), spread("to_symbol_id") == F.col("k_ts"), "left")
        .join(side(f, "k_tf", "to_file"), spread("to_file_id") == F.col("k_tf"), "left")
    )
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("id", blank("from_symbol"), "from_file", blank("to_symbol"), blank("to_file"), "reference_kind", "confidence", zero("line"), zero("column_start"), zero("column_end"), blank("raw_target_text"), "is_resolved")


def _named(t: IndexTables, name: str, key: str) -> DataFrame:
    return t.symbols.filter((F.col("name") == name) | (F.col("qualified_name") == name)).select(F.col("id").alias(key))


def _of_symbol(t: IndexTables, name: str, kind: str, column: str) -> DataFrame:
    r = t.refs.filter(F.col("reference_kind") == kind)
    return _with_ends(t, r.join(_named(t, name, "k"), F.col(column) == F.col("k"), "left_semi")).orderBy("confidence", "from_file", "line")


def who_calls(t: IndexTables, name: str) -> DataFrame:
    return _of_symbol(t, name, "calls", "to_symbol_id")


def calls(t: IndexTables, name: str) -> DataFrame:
    return _of_symbol(t, name, "calls", "from_symbol_id")


def implementations(t: IndexTables, name: str) -> DataFrame:
    return _of_symbol(t, name, "implements", "to_symbol_id")


def tests_for(t: IndexTables, name: str) -> DataFrame:
    return _of_symbol(t, name, "tests", "to_symbol_id")


def imports(t: IndexTables, package: str) -> DataFrame:
    raw = F.col("raw_target_text")
    return _with_ends(t, t.refs.filter((F.col("reference_kind") == "imports") & ((raw == package) | like(raw, "%/" + package)))).orderBy("confidence", "from_file", "line")


def touches(t: IndexTables, kind: str, name: str) -> DataFrame:
    """All references of every file that owns a matching artifact."""
    a = t.artifacts.filter((F.col("artifact_kind") == kind) & contains(F.col("name"), name)).select(F.col("file_id").alias("k"))
    return _with_ends(t, t.refs.join(a, F.col("from_file_id") == F.col("k"), "left_semi")).orderBy("from_file", "line")


def latest_diagnostics(t: IndexTables) -> DataFrame:
    """Diagnostics of the run with the greatest id."""
    last = t.index_runs.agg(F.max("id").alias("k"))
    d = t.diagnostics.join(last, F.col("run_id") == F.col("k"), "left_semi")
    f = t.files.select(F.col("id").alias("f_id"), F.col("path").alias("file_path"))
    rows = d.join(f, F.col("file_id") == F.col("f_id"), "left")
    return rows.select("id", "severity", "code", "message", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("line", F.lit(0)).alias("line"), "run_id").orderBy("severity", "file_path", "line")
