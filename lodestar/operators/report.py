"""Statistics, staleness, validation and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.schema import FOREIGN_KEYS, IndexTables

# ---- statistics


def count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias(name)).agg(F.count("*").alias("n"))


def stats(t: IndexTables) -> DataFrame:
    """(metric, key, n): every count of the statistics command in one plan."""
    one = lambda df, metric: df.agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "n")
    by = lambda df, c, metric: df.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "key", "n")
    parts = [
        by(t.files, "language", "files_by_language"), one(t.packages, "packages"), by(t.symbols, "symbol_kind", "symbols_by_kind"),
        by(t.refs, "reference_kind", "references_by_kind"), by(t.artifacts, "artifact_kind", "artifacts_by_kind"),
        one(stale_files(t), "stale_files"), one(stale_packages(t), "stale_packages"), one(stale_symbols(t), "stale_symbols"),
    ]
    return reduce(DataFrame.unionByName, parts)


def last_run(t: IndexTables) -> DataFrame:
    return t.index_runs.orderBy(F.desc("id")).limit(1).select("id", "status", "mode", "files_scanned", "files_changed", "started_at", F.coalesce("finished_at", F.lit("")).alias("finished_at"), "error_count", "warning_count")


# ---- staleness


def _stale(kind: str, df: DataFrame, entity: Column, name: Column, current: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), entity.alias("entity_id"), name.alias("entity_name"), F.col("generated_from_hash").alias("stored_hash"), current.alias("current_hash"), "generator_version")


def stale_files(t: IndexTables) -> DataFrame:
    f = t.files.select(F.col("id").alias("f_id"), "path", "content_hash")
    rows = t.file_summaries.join(f, F.col("file_id") == F.col("f_id")).filter("generated_from_hash <> content_hash")
    return _stale("file", rows, F.col("file_id"), F.col("path"), F.col("content_hash"))


def stale_packages(t: IndexTables, compat: str = "reference") -> DataFrame:
    """Packages whose stored hash differs from the hash of any file; mode "fixed" compares the composite hash."""
    p = t.packages.select(F.col("id").alias("p_id"), "name")
    s = t.package_summaries.join(p, F.col("package_id") == F.col("p_id"))
    if compat == "fixed":
        now = composite_hashes(t).select(F.col("package_id").alias("k"), "composite_hash")
        rows = s.join(now, F.col("package_id") == F.col("k")).filter("generated_from_hash <> composite_hash")
    else:
        h = t.package_files.join(t.files.select(F.col("id").alias("f_id"), "content_hash"), F.col("file_id") == F.col("f_id")).select(F.col("package_id").alias("k"), "content_hash")
        rows = s.join(h, (F.col("package_id") == F.col("k")) & (F.col("content_hash") != F.col("generated_from_hash")), "left_semi")
    return _stale("package", rows, F.col("package_id"), F.col("name"), F.lit("(multiple files changed)"))


def stale_symbols(t: IndexTables) -> DataFrame:
    s = t.symbols.select(F.col("id").alias("s_id"), "qualified_name", "file_id").join(t.files.select(F.col("id").alias("f_id"), "content_hash"), F.col("file_id") == F.col("f_id"))
    rows = t.symbol_summaries.join(s, F.col("symbol_id") == F.col("s_id")).filter("generated_from_hash <> content_hash")
    return _stale("symbol", rows, F.col("symbol_id"), F.col("qualified_name"), F.col("content_hash"))


def stale_all(t: IndexTables) -> DataFrame:
    return stale_files(t).unionByName(stale_packages(t)).unionByName(stale_symbols(t))


def composite_hashes(t: IndexTables) -> DataFrame:
    """Per package the hashes of its files, in path order, joined by colons."""
    f = t.files.select(F.col("id").alias("f_id"), "path", "content_hash")
    rows = t.package_files.join(f, F.col("file_id") == F.col("f_id"))
    listed = F.array_sort(F.collect_list(F.struct("path", "content_hash")))
    return rows.groupBy("package_id").agg(F.array_join(F.transform(listed, lambda x: x["content_hash"]), ":").alias("composite_hash"))


# ---- validation

# Keys that an artifact's data must have.
REQUIRED_KEYS = {
    "route": ["method", "path"], "config_key": ["key"], "migration": ["table"], "sql_query": ["table"], "background_job": ["type"], "queue_consumer": ["type"],
    "external_service": ["url"], "cli_command": ["name"], "env_var": ["key"], "feature_flag": ["key"],
}
MAX_TEXT, MAX_ENTRY = 500, 100


def foreign_keys(t: IndexTables) -> DataFrame:
    """(child, fk_column, violations) for each of the foreign keys: one anti join for each parent.

    Values are counted before the join, so a hot parent is one row, and a child is read once for all its keys to a parent.
    """
    parts = []
    for parent, key in dict.fromkeys((p, k) for _, _, p, k, _ in FOREIGN_KEYS):
        columns: dict[str, list[str]] = {}
        for child, column, up, _, _ in FOREIGN_KEYS:
            if up == parent:
                columns.setdefault(child, []).append(column)
        named = lambda child, c: F.struct(F.lit(child).alias("child"), F.lit(c).alias("fk_column"), F.col(c).alias("v"))
        values = [getattr(t, child).select(F.explode(F.array(*[named(child, c) for c in cs])).alias("x")).select("x.*") for child, cs in columns.items()]
        counted = reduce(DataFrame.unionByName, values).filter("v is not null").groupBy("child", "fk_column", "v").agg(F.count("*").alias("n"))
        parts.append(counted.join(getattr(t, parent).select(F.col(key).alias("k")), F.col("v") == F.col("k"), "left_anti").select("child", "fk_column", "n"))
    every = t.files.sparkSession.createDataFrame([(child, column, 0) for child, column, *_ in FOREIGN_KEYS], "child string, fk_column string, n bigint")
    return reduce(DataFrame.unionByName, parts).unionByName(every).groupBy("child", "fk_column").agg(F.sum("n").cast("long").alias("violations"))


def _n(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations"))


def duplicate_stable_ids(t: IndexTables) -> DataFrame:
    return _n(t.symbols.groupBy("stable_id").count().filter("count > 1"))


def orphaned_symbols(t: IndexTables) -> DataFrame:
    return _n(t.symbols.select("file_id").join(t.files.select(F.col("id").alias("k")), F.col("file_id") == F.col("k"), "left_anti"))


def orphaned_package_files(t: IndexTables) -> DataFrame:
    p, f = t.packages.select(F.col("id").alias("p_id")).distinct(), t.files.select(F.col("id").alias("f_id")).distinct()
    return _n(t.package_files.join(p, F.col("package_id") == F.col("p_id"), "left").join(f, F.col("file_id") == F.col("f_id"), "left").filter("p_id is null or f_id is null"))


def stale_summaries(t: IndexTables) -> DataFrame:
    return _n(stale_files(t))


def _file_packages(t: IndexTables) -> DataFrame:
    f = t.files.select(F.col("id").alias("f_id"), "package_name", "module_name")
    p = t.packages.select(F.col("id").alias("p_id"), "name", "import_path")
    return t.package_files.join(f, F.col("file_id") == F.col("f_id")).join(p, F.col("package_id") == F.col("p_id"))


def denormalised_package(t: IndexTables) -> DataFrame:
    return _n(_file_packages(t).filter("package_name is not null and package_name <> name"))


def denormalised_module(t: IndexTables) -> DataFrame:
    return _n(_file_packages(t).filter("module_name is not null and import_path is not null and module_name <> import_path"))


def text_length(t: IndexTables) -> DataFrame:
    parts = [x.select("summary_text") for x in (t.file_summaries, t.package_summaries, t.symbol_summaries)]
    return _n(reduce(DataFrame.unionByName, parts).filter(F.length("summary_text") > MAX_TEXT))


def entry_length(t: IndexTables) -> DataFrame:
    """Entries of the checked arrays over 100 bytes, counted inside each row: no explode."""
    checked = [(t.file_summaries, ("responsibilities", "key_symbols", "dependencies", "public_api")), (t.package_summaries, ("major_responsibilities", "exported_surface")), (t.symbol_summaries, ("intent", "related_symbols"))]
    long = lambda c: F.coalesce(F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.octet_length(x) > MAX_ENTRY)), F.lit(0))
    parts = [df.select(sum((long(c) for c in cols), F.lit(0)).alias("n")) for df, cols in checked]
    return reduce(DataFrame.unionByName, parts).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations"))


def artifact_keys(t: IndexTables) -> DataFrame:
    """One violation for broken JSON, else one for each missing key."""
    table = F.create_map(*[x for k, v in REQUIRED_KEYS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    need = F.element_at(table, F.col("artifact_kind"))
    keys = F.json_object_keys("data_json")
    bad = F.when(keys.isNull(), F.lit(1)).otherwise(F.size(F.array_except(need, keys)))
    return t.artifacts.filter(F.col("artifact_kind").isin(list(REQUIRED_KEYS))).agg(F.coalesce(F.sum(bad), F.lit(0)).cast("long").alias("violations"))


CHECKS = {
    "duplicate_stable_ids": duplicate_stable_ids, "orphaned_symbols": orphaned_symbols, "orphaned_package_files": orphaned_package_files, "stale_summaries": stale_summaries,
    "denorm_package_name": denormalised_package, "denorm_module_name": denormalised_module, "summary_text_length": text_length, "summary_array_entry_length": entry_length, "artifact_data_json": artifact_keys,
}


def validation_report(t: IndexTables) -> DataFrame:
    """(name, status, violations) of every check that needs no file system."""
    fk = foreign_keys(t).agg(F.sum("violations").cast("long").alias("violations")).withColumn("name", F.lit("foreign_keys"))
    parts = [fk, *[f(t).withColumn("name", F.lit(n)) for n, f in CHECKS.items()]]
    return reduce(DataFrame.unionByName, parts).select("name", F.when(F.col("violations") > 0, "fail").otherwise("pass").alias("status"), "violations")


# ---- exports


def export_summary(t: IndexTables) -> DataFrame:
    """(section, item, n) of the repository summary: languages, packages, entry points, counts."""
    row = lambda df, section, item, n: df.select(F.lit(section).alias("section"), item.alias("item"), n.cast("long").alias("n"))
    r = last_run(t)
    return reduce(DataFrame.unionByName, [
        row(t.files.select("language").distinct(), "language", F.col("language"), F.lit(1)),
        row(export_packages(t), "package", F.col("name"), F.col("file_count")),
        row(t.symbols.filter("symbol_kind = 'entrypoint'"), "entrypoint", F.col("qualified_name"), F.lit(1)),
        row(t.artifacts.filter("artifact_kind = 'route'").agg(F.count("*").alias("n")), "routes", F.lit(""), F.col("n")),
        row(r, "errors", F.col("started_at"), F.col("error_count")),
        row(r, "warnings", F.col("started_at"), F.col("warning_count")),
        row(stale_files(t).agg(F.count("*").alias("n")), "stale_files", F.lit(""), F.col("n")),
        row(stale_packages(t).agg(F.count("*").alias("n")), "stale_packages", F.lit(""), F.col("n")),
        row(stale_symbols(t).agg(F.count("*").alias("n")), "stale_symbols", F.lit(""), F.col("n")),
    ])


def _files(t: IndexTables) -> DataFrame:
    return t.files.select(F.col("id").alias("f_id"), F.col("path").alias("file"), "language")


def export_nodes(t: IndexTables) -> DataFrame:
    return t.symbols.join(_files(t), F.col("file_id") == F.col("f_id")).select("stable_id", "name", F.col("symbol_kind").alias("kind"), "file", "language").orderBy("stable_id")


def export_edges(t: IndexTables) -> DataFrame:
    s = t.symbols.select("id", "stable_id")
    r = t.refs.filter("from_symbol_id is not null or to_symbol_id is not null")
    r = r.join(s.select(F.col("id").alias("k1"), F.col("stable_id").alias("a")), F.col("from_symbol_id") == F.col("k1"), "left").join(s.select(F.col("id").alias("k2"), F.col("stable_id").alias("b")), F.col("to_symbol_id") == F.col("k2"), "left")
    return r.select(F.coalesce("a", F.lit("")).alias("from"), F.coalesce("b", F.lit("")).alias("to"), F.col("reference_kind").alias("kind"), "confidence")


def export_symbols(t: IndexTables) -> DataFrame:
    zero = F.lit(0)
    rows = t.symbols.join(_files(t), F.col("file_id") == F.col("f_id"))
    return rows.select("stable_id", "name", "qualified_name", F.col("symbol_kind").alias("kind"), "visibility", "file", F.coalesce("start_line", zero).alias("start_line"), F.coalesce("end_line", zero).alias("end_line")).orderBy("file", "start_line")


def export_packages(t: IndexTables) -> DataFrame:
    n = t.package_files.groupBy(F.col("package_id").alias("k")).agg(F.count("file_id").alias("n"))
    rows = t.packages.join(n, F.col("id") == F.col("k"), "left")
    return rows.select("name", F.coalesce("import_path", F.lit("")).alias("import_path"), "directory_path", "language", F.coalesce("n", F.lit(0)).alias("file_count")).orderBy("name")


def export_routes(t: IndexTables) -> DataFrame:
    """Routes whose data is a JSON object of strings."""
    a = t.artifacts.filter("artifact_kind = 'route'").withColumn("data", F.from_json("data_json", "map<string,string>")).filter(F.col("data").isNotNull() & F.json_object_keys("data_json").isNotNull())
    rows = a.join(_files(t), F.col("file_id") == F.col("f_id")).join(t.symbols.select(F.col("id").alias("s_id"), F.col("start_line").alias("at")), F.col("symbol_id") == F.col("s_id"), "left")
    part = lambda k: F.coalesce(F.element_at("data", F.lit(k)), F.lit("")).alias(k)
    return rows.select(part("method"), part("path"), part("handler"), "file", F.coalesce("at", F.lit(0)).alias("line"), "confidence").orderBy("file")


def export_diagnostics(t: IndexTables) -> DataFrame:
    last = t.index_runs.orderBy(F.desc("id")).limit(1).select(F.col("id").alias("k"))
    d = t.diagnostics.join(F.broadcast(last), F.col("run_id") == F.col("k"), "left_semi").join(_files(t).drop("language"), F.col("file_id") == F.col("f_id"), "left")
    return d.select("severity", "code", "message", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line")).orderBy("severity", "file", "line")
