"""Summaries of files, packages and symbols: three set-based plans, one aggregation per input table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.compat import truncate_bytes
from lodestar.operators.report import composite_hashes
from lodestar.schema import GENERATOR_VERSION, IndexTables

MAX_TEXT, MAX_ENTRY = 500, 100
# Reference kinds that count as side effects.
SIDE_EFFECTS = ["registers_route", "uses_config", "touches_table", "invokes_external_api"]


def _entries(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: truncate_bytes(x, MAX_ENTRY))


def _listed(value: Column, *order: Column, when: Column | None = None) -> Column:
    """The values of a group in order, nulls of `when` left out."""
    s = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(F.when(when, s) if when is not None else s)), lambda x: x["v"])


def _none() -> Column:
    return F.array().cast("array<string>")


def is_external(dep: Column) -> Column:
    return F.contains(dep, F.lit(".")) & ~dep.startswith("golang.org") & ~dep.startswith("google.golang.org")


def file_summaries(t: IndexTables, only_ok: bool = True) -> DataFrame:
    f = t.files.filter("parse_status = 'ok'") if only_ok else t.files
    shown = F.when(F.coalesce("signature", F.lit("")) != "", F.col("signature")).otherwise(F.col("name"))
    exported = F.col("visibility") == "exported"
    order = (F.coalesce("start_line", F.lit(-1)), F.col("id"))
    s = t.symbols.groupBy(F.col("file_id").alias("k1")).agg(
        F.count("*").alias("n"), F.count_if(exported).alias("n_exported"),
        _listed(F.concat_ws(" ", "symbol_kind", "name"), *order).alias("responsibilities"),
        _listed(F.col("name"), *order, when=exported).alias("key_symbols"),
        _listed(shown, *order, when=exported).alias("public_api"),
    )
    raw = t.refs.filter("raw_target_text is not null")
    deps = raw.filter("reference_kind = 'imports'")
    effects = raw.filter(F.col("reference_kind").isin(SIDE_EFFECTS))
    r = deps.select("from_file_id", F.lit(True).alias("dep"), F.col("raw_target_text").alias("v")).unionByName(effects.select("from_file_id", F.lit(False).alias("dep"), F.concat("reference_kind", F.lit(": "), "raw_target_text").alias("v")))
    r = r.groupBy(F.col("from_file_id").alias("k2")).agg(F.array_sort(F.collect_set(F.when(F.col("dep"), F.col("v")))).alias("deps"), F.array_sort(F.collect_set(F.when(~F.col("dep"), F.col("v")))).alias("effects"))
    a = t.artifacts.groupBy(F.col("file_id").alias("k3")).agg(_listed(F.concat_ws(":", "artifact_kind", "name"), F.col("id")).alias("related"))
    rows = f.join(s, F.col("id") == F.col("k1"), "left").join(r, F.col("id") == F.col("k2"), "left").join(a, F.col("id") == F.col("k3"), "left")
    pkg = F.when(F.coalesce("package_name", F.lit("")) != "", F.col("package_name")).otherwise("unknown")
    n_deps = F.coalesce(F.size("deps"), F.lit(0))
    text = F.concat(
        F.lit("File "), "path", F.lit(" in package "), pkg, F.lit("."),
        F.when(F.coalesce("n", F.lit(0)) > 0, F.concat(F.lit(" Contains "), F.col("n").cast("string"), F.lit(" symbols ("), F.col("n_exported").cast("string"), F.lit(" exported)."))).otherwise(""),
        F.when(n_deps > 0, F.concat(F.lit(" Imports "), n_deps.cast("string"), F.lit(" packages."))).otherwise(""),
    )
    return rows.select(
        F.col("id").alias("file_id"), truncate_bytes(text, MAX_TEXT).alias("summary_text"), _entries(F.col("responsibilities")).alias("responsibilities"), _entries(F.col("key_symbols")).alias("key_symbols"),
        _none().alias("invariants"), _entries(F.col("effects")).alias("side_effects"), _entries(F.col("deps")).alias("dependencies"), _entries(F.col("public_api")).alias("public_api"), _none().alias("risks"),
        _entries(F.col("related")).alias("related_artifacts"), F.col("content_hash").alias("generated_from_hash"), F.lit(GENERATOR_VERSION).alias("generator_version"),
    )


def package_summaries(t: IndexTables) -> DataFrame:
    pf = t.package_files
    shown = F.when(F.coalesce("signature", F.lit("")) != "", F.col("signature")).otherwise(F.col("name"))
    exported = F.col("visibility") == "exported"
    s = pf.select("package_id", F.col("file_id").alias("k")).join(t.symbols.drop("package_id"), F.col("file_id") == F.col("k")).groupBy(F.col("package_id").alias("k1")).agg(
        F.count("*").alias("n"), F.count_if(exported).alias("n_exported"),
        _listed(F.concat_ws(" ", "symbol_kind", "name"), F.col("name"), F.col("id")).alias("responsibilities"),
        _listed(shown, F.col("name"), F.col("id"), when=exported).alias("surface"),
    )
    deps = t.refs.filter("reference_kind = 'imports' and raw_target_text is not null").select("from_file_id", F.col("raw_target_text").alias("dep"))
    r = pf.join(deps, F.col("file_id") == F.col("from_file_id")).groupBy(F.col("package_id").alias("k2")).agg(
        F.array_sort(F.collect_set(F.when(~is_external(F.col("dep")), F.col("dep")))).alias("internal"), F.array_sort(F.collect_set(F.when(is_external(F.col("dep")), F.col("dep")))).alias("external")
    )
    h = composite_hashes(t).withColumnRenamed("package_id", "k3")
    rows = t.packages.join(s, F.col("id") == F.col("k1"), "left").join(r, F.col("id") == F.col("k2"), "left").join(h, F.col("id") == F.col("k3"), "left")
    n, e = F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("n_exported", F.lit(0)).cast("string")
    text = F.concat(F.lit("Package "), "name", F.lit(" ("), "language", F.lit("). "), n, F.lit(" symbols ("), e, F.lit(" exported)."))
    return rows.select(
        F.col("id").alias("package_id"), truncate_bytes(text, MAX_TEXT).alias("summary_text"), _entries(F.col("responsibilities")).alias("major_responsibilities"), _entries(F.col("surface")).alias("exported_surface"),
        _entries(F.col("internal")).alias("internal_collaborators"), _entries(F.col("external")).alias("external_dependencies"), _none().alias("notable_invariants"), _none().alias("risks"),
        F.coalesce("composite_hash", F.lit("")).alias("generated_from_hash"), F.lit(GENERATOR_VERSION).alias("generator_version"),
    )


def symbol_summaries(t: IndexTables, only: DataFrame | None = None) -> DataFrame:
    """Summaries of all symbols, or only of those with these ids (k)."""
    f = t.files.select(F.col("id").alias("f_id"), "content_hash")
    c = t.refs.filter("reference_kind = 'calls'")
    made, named, back = t.symbols, c, c.filter("to_symbol_id is not null").select("from_symbol_id", "to_symbol_id")
    if only is not None:
        of = lambda df, column: df.join(only, F.col(column) == F.col("k"), "left_semi")
        made, named, back = of(made, "id"), of(named, "from_symbol_id"), of(back, "to_symbol_id")
    out = named.filter("coalesce(raw_target_text, '') <> ''").groupBy(F.col("from_symbol_id").alias("k1")).agg(F.array_sort(F.collect_set("raw_target_text")).alias("called"))
    callers = t.symbols.select(F.col("id").alias("c_id"), F.col("qualified_name").alias("caller")).filter("caller <> ''")
    back = back.join(callers, F.col("from_symbol_id") == F.col("c_id")).groupBy(F.col("to_symbol_id").alias("k2")).agg(F.array_sort(F.collect_set(F.concat(F.lit("called by "), "caller"))).alias("callers"))
    rows = made.join(f, F.col("file_id") == F.col("f_id")).join(out, F.col("id") == F.col("k1"), "left").join(back, F.col("id") == F.col("k2"), "left")
    some = lambda v: F.when(F.coalesce(v, F.lit("")) != "", F.array(v)).otherwise(_none())
    related = F.concat(F.coalesce("called", _none()), F.coalesce("callers", _none()))
    intent = F.concat(some(F.col("doc_comment")), F.array(F.concat(F.col("visibility"), F.lit(" "), F.col("symbol_kind"), F.lit(" ("), F.col("name"), F.lit(")"))))
    return rows.select(
        F.col("id").alias("symbol_id"), truncate_bytes(F.concat("visibility", F.lit(" "), "symbol_kind", F.lit(" "), "qualified_name", F.lit(".")), MAX_TEXT).alias("summary_text"),
        _entries(intent).alias("intent"), _entries(some(F.col("signature"))).alias("inputs"), _none().alias("outputs"), _none().alias("side_effects"), _none().alias("failure_modes"), _none().alias("invariants"),
        _entries(related).alias("related_symbols"), F.col("content_hash").alias("generated_from_hash"), F.lit(GENERATOR_VERSION).alias("generator_version"),
    )
