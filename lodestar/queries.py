"""Registered queries over the virtual index: name -> (operator call, DuckDB SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.extract.comments import code_lines
from lodestar.extract.registry import extract
from lodestar.functions import compat
from lodestar.operators import find, maintain, report
from lodestar.plans import summaries
from lodestar.plans.virtual import oracle, virtual_index
from lodestar.samples import GENERATED, RELATIONS, SAMPLES
from lodestar.session import table

UP, LOW = compat.UPPER, compat.LOWER


def _l(c: str) -> str:
    return f"translate({c}, '{UP}', '{LOW}')"


RANK = "CASE WHEN {q} THEN 0 WHEN {s} THEN 1 WHEN {n} THEN 2 {f} END"


def _find_sql(name: str, keep: str = "true", fuzzy: str = "") -> str:
    f = f"WHEN {fuzzy} THEN 3" if fuzzy else ""
    rank = RANK.format(q=f"qualified_name = '{name}' AND {keep}", s=f"stable_id = '{name}' AND {keep}", n=f"s.name = '{name}' AND {keep}", f=f)
    return f"""SELECT id, file_id, package_id, name, qualified_name, symbol_kind, visibility, signature, doc_comment, start_line, end_line, stable_id, file_path, ['exact_qualified', 'exact_stable_id', 'exact_name', 'fuzzy'][r + 1] AS match_type
        FROM (SELECT s.id, s.file_id, s.package_id, s.name, qualified_name, symbol_kind, visibility, coalesce(signature, '') AS signature, coalesce(doc_comment, '') AS doc_comment, start_line, end_line, stable_id, f.path AS file_path, {rank} AS r
        FROM symbols s JOIN files f ON s.file_id = f.id) WHERE r IS NOT NULL"""


ENDS = """SELECT r.id, coalesce(sf.qualified_name, '') AS from_symbol, ff.path AS from_file, coalesce(st.qualified_name, '') AS to_symbol, coalesce(tf.path, '') AS to_file, r.reference_kind, r.confidence,
    coalesce(r.line, 0) AS line, 0::BIGINT AS column_start, 0::BIGINT AS column_end, coalesce(r.raw_target_text, '') AS raw_target_text, r.is_resolved
    FROM refs r JOIN files ff ON r.from_file_id = ff.id LEFT JOIN symbols sf ON r.from_symbol_id = sf.id LEFT JOIN symbols st ON r.to_symbol_id = st.id LEFT JOIN files tf ON r.to_file_id = tf.id WHERE """
ART = """SELECT a.id, a.artifact_kind, a.name, f.path AS file_path, coalesce(s.qualified_name, '') AS symbol_name, a.data_json, a.confidence FROM artifacts a JOIN files f ON a.file_id = f.id LEFT JOIN symbols s ON a.symbol_id = s.id WHERE a.artifact_kind = """
PACK = """SELECT p.id, p.name, coalesce(p.import_path, '') AS import_path, p.directory_path, p.language, (SELECT count(*) FROM package_files pf WHERE pf.package_id = p.id) AS file_count, (SELECT count(*) FROM symbols s WHERE s.package_id = p.id) AS symbol_count FROM packages p"""
FILE = "SELECT id, path, language, coalesce(package_name, '') AS package_name, content_hash, size_bytes, is_generated, parse_status FROM files WHERE "
STALE_F = "SELECT 'file' AS kind, fs.file_id AS entity_id, f.path AS entity_name, fs.generated_from_hash AS stored_hash, f.content_hash AS current_hash, fs.generator_version FROM file_summaries fs JOIN files f ON fs.file_id = f.id WHERE fs.generated_from_hash <> f.content_hash"
STALE_P = "SELECT 'package' AS kind, ps.package_id AS entity_id, p.name AS entity_name, ps.generated_from_hash AS stored_hash, '(multiple files changed)' AS current_hash, ps.generator_version FROM package_summaries ps JOIN packages p ON ps.package_id = p.id WHERE EXISTS (SELECT 1 FROM package_files pf JOIN files f ON pf.file_id = f.id WHERE pf.package_id = ps.package_id AND f.content_hash <> ps.generated_from_hash)"
STALE_P_FIXED = STALE_P.split(" WHERE EXISTS")[0] + " WHERE ps.generated_from_hash <> (SELECT string_agg(f.content_hash, ':' ORDER BY f.path) FROM package_files pf JOIN files f ON pf.file_id = f.id WHERE pf.package_id = ps.package_id)"
STALE_S = "SELECT 'symbol' AS kind, ss.symbol_id AS entity_id, s.qualified_name AS entity_name, ss.generated_from_hash AS stored_hash, f.content_hash AS current_hash, ss.generator_version FROM symbol_summaries ss JOIN symbols s ON ss.symbol_id = s.id JOIN files f ON s.file_id = f.id WHERE ss.generated_from_hash <> f.content_hash"
NAMED = "(SELECT id FROM symbols WHERE name = '{0}' OR qualified_name = '{0}')"


def _joined(df: DataFrame, columns: dict[str, str], *plain: str) -> DataFrame:
    """Arrays as text, for comparison."""
    return df.select(*plain, *[F.array_join(c, "; ").alias(n) for n, c in columns.items()])


NAME = "red widget"
CHECK_SQL = {
    "duplicate_stable_ids": "SELECT count(*) AS violations FROM (SELECT stable_id FROM symbols GROUP BY stable_id HAVING count(*) > 1)",
    "orphaned_symbols": "SELECT count(*) AS violations FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.id = s.file_id)",
    "orphaned_package_files": "SELECT count(*) AS violations FROM package_files pf WHERE NOT EXISTS (SELECT 1 FROM packages p WHERE p.id = pf.package_id) OR NOT EXISTS (SELECT 1 FROM files f WHERE f.id = pf.file_id)",
    "stale_summaries": "SELECT count(*) AS violations FROM file_summaries fs JOIN files f ON fs.file_id = f.id WHERE fs.generated_from_hash <> f.content_hash",
    "denorm_package_name": "SELECT count(*) AS violations FROM files f JOIN package_files pf ON f.id = pf.file_id JOIN packages p ON pf.package_id = p.id WHERE f.package_name IS NOT NULL AND f.package_name <> p.name",
    "denorm_module_name": "SELECT count(*) AS violations FROM files f JOIN package_files pf ON f.id = pf.file_id JOIN packages p ON pf.package_id = p.id WHERE f.module_name IS NOT NULL AND p.import_path IS NOT NULL AND f.module_name <> p.import_path",
    "summary_text_length": "SELECT count(*) AS violations FROM (SELECT summary_text FROM file_summaries UNION ALL SELECT summary_text FROM package_summaries UNION ALL SELECT summary_text FROM symbol_summaries) WHERE length(summary_text) > 500",
    "summary_array_entry_length": "SELECT count(*) AS violations FROM (SELECT unnest(responsibilities) AS e FROM file_summaries UNION ALL SELECT unnest(key_symbols) FROM file_summaries) WHERE strlen(e) > 100",
    "artifact_data_json": """SELECT coalesce(sum(CASE WHEN NOT json_valid(data_json) THEN 1 ELSE CASE WHEN list_contains(keys, need[1]) THEN 0 ELSE 1 END + CASE WHEN len(need) < 2 OR list_contains(keys, need[2]) THEN 0 ELSE 1 END END), 0)::BIGINT AS violations
        FROM (SELECT json_keys(CASE WHEN json_valid(data_json) THEN data_json ELSE '{}' END) AS keys, data_json, CASE artifact_kind WHEN 'route' THEN ['method', 'path'] WHEN 'config_key' THEN ['key'] WHEN 'migration' THEN ['table'] WHEN 'background_job' THEN ['type'] WHEN 'external_service' THEN ['url'] WHEN 'sql_query' THEN ['table'] WHEN 'cli_command' THEN ['name'] WHEN 'env_var' THEN ['key'] END AS need FROM artifacts)""",
}
FK_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS child, '{col}' AS fk_column, count(*) AS violations FROM {c} x WHERE x.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{k} = x.{col})"
    for c, col, p, k, _ in report.FOREIGN_KEYS
)
REPORT_SQL = " UNION ALL ".join([f"SELECT 'foreign_keys' AS name, CASE WHEN sum(violations) > 0 THEN 'fail' ELSE 'pass' END AS status, sum(violations)::BIGINT AS violations FROM ({FK_SQL})"] + [f"SELECT '{n}', CASE WHEN violations > 0 THEN 'fail' ELSE 'pass' END, violations FROM ({s})" for n, s in CHECK_SQL.items()])
EXP_PACK = "SELECT p.name, coalesce(p.import_path, '') AS import_path, p.directory_path, p.language, count(pf.file_id) AS file_count FROM packages p LEFT JOIN package_files pf ON p.id = pf.package_id GROUP BY ALL"
RESOLVE_SQL = """SELECT r.id, CASE WHEN s.id IS NOT NULL THEN s.id ELSE r.to_symbol_id END AS to_symbol_id, CASE WHEN s.id IS NOT NULL THEN s.file_id ELSE r.to_file_id END AS to_file_id, (s.id IS NOT NULL OR r.is_resolved) AS is_resolved
    FROM refs r LEFT JOIN (SELECT qualified_name, min(id) AS id, arg_min(file_id, id) AS file_id, count(*) AS n FROM symbols GROUP BY qualified_name) s ON NOT r.is_resolved AND r.raw_target_text = s.qualified_name"""
STATS = {
    "stats_files_by_language": ("files", "language", "language"), "stats_symbols_by_kind": ("symbols", "symbol_kind", "kind"),
    "stats_refs_by_kind": ("refs", "reference_kind", "kind"), "stats_artifacts_by_kind": ("artifacts", "artifact_kind", "kind"),
}

#: Index queries: name -> (function of the index tables, SQL over the views).
INDEX = {
    "who_calls": (lambda t: find.who_calls(t, NAME), ENDS + f"r.to_symbol_id IN {NAMED.format(NAME)} AND r.reference_kind = 'calls'"),
    "calls": (lambda t: find.calls(t, NAME), ENDS + f"r.from_symbol_id IN {NAMED.format(NAME)} AND r.reference_kind = 'calls'"),
    "implementations": (lambda t: find.implementations(t, NAME), ENDS + f"r.to_symbol_id IN {NAMED.format(NAME)} AND r.reference_kind = 'implements'"),
    "tests_for": (lambda t: find.tests_for(t, NAME), ENDS + f"r.to_symbol_id IN {NAMED.format(NAME)} AND r.reference_kind = 'tests'"),
    "imports_suffix": (lambda t: find.imports(t, NAME), ENDS + f"(r.raw_target_text = '{NAME}' OR {_l('r.raw_target_text')} LIKE '%/{NAME.lower()}') AND r.reference_kind = 'imports'"),
    "touches": (lambda t: find.touches(t, "route", "orders/7"), ENDS + f"r.from_file_id IN (SELECT a.file_id FROM artifacts a WHERE a.artifact_kind = 'route' AND {_l('a.name')} LIKE '%orders/7%')"),
    "find_symbol_exact": (lambda t: find.find_symbol(t, NAME), _find_sql(NAME)),
    "find_symbol_stable_id": (lambda t: find.find_symbol(t, "part:12"), _find_sql("part:12")),
    "find_symbol_fuzzy": (lambda t: find.find_symbol(t, "bLUe _o", fuzzy=True), _find_sql("bLUe _o", fuzzy=f"{_l('s.name')} LIKE '%blue _o%' OR {_l('qualified_name')} LIKE '%blue _o%'")),
    "find_symbol_fuzzy_filtered": (lambda t: find.find_symbol(t, "#1", fuzzy=True, kind="struct", visibility="exported"), _find_sql("#1", "symbol_kind = 'struct' AND visibility = 'exported'", f"{_l('s.name')} LIKE '%#1%' OR {_l('qualified_name')} LIKE '%#1%' AND symbol_kind = 'struct' AND visibility = 'exported'")),
    "find_symbol_fuzzy_fixed": (lambda t: find.find_symbol(t, "#1", fuzzy=True, kind="struct", compat="fixed"), _find_sql("#1", "symbol_kind = 'struct'", f"({_l('s.name')} LIKE '%#1%' OR {_l('qualified_name')} LIKE '%#1%') AND symbol_kind = 'struct'")),
    "find_symbol_pkg_filter": (lambda t: find.find_symbol(t, NAME, package="example.com/src7", file="SRC", language="en"), _find_sql(NAME, f"package_id IN (SELECT id FROM packages WHERE name = 'example.com/src7' OR import_path = 'example.com/src7') AND {_l('f.path')} LIKE '%src%' AND f.language = 'en'")),
    "find_file_like": (lambda t: find.find_file(t, "EN/doc_1"), FILE + f"{_l('path')} LIKE '%en/doc_1%'"),
    "find_file_exact": (lambda t: find.find_file(t, "src7/en/doc_7.txt", exact=True), FILE + "path = 'src7/en/doc_7.txt'"),
    "find_file_glob": (lambda t: find.find_file(t, "doc", include=["src1*/**", "src[2-4]/{en,fr}/*"], exclude=["**/doc_?.txt", "src11/**"]), FILE + f"{_l('path')} LIKE '%doc%' AND (regexp_matches(path, '^src1[^/]*/.*$') OR regexp_matches(path, '^src[2-4]/(en|fr)/[^/]*$')) AND NOT regexp_matches(path, '^(.*/)?doc_[^/]\\.txt$') AND NOT regexp_matches(path, '^src11/.*$')"),
    "find_package": (lambda t: find.find_package(t, "example.com/src3"), PACK + " WHERE p.name = 'example.com/src3' OR p.import_path = 'example.com/src3'"),
    "list_packages": (find.list_packages, PACK),
    "find_route": (lambda t: find.artifacts_of(t, "route", "get /"), ART + f"'route' AND {_l('a.name')} LIKE '%get /%'"),
    "find_config": (lambda t: find.artifacts_of(t, "config_key", "orders/1_"), ART + f"'config_key' AND {_l('a.name')} LIKE '%orders/1_%'"),
    **{f"list_{w}": (lambda t, w=w: find.list_artifacts(t, w), ART + f"'{k}'") for w, k in find.LISTINGS.items()},
    "list_entrypoints_fixed": (lambda t: find.list_artifacts(t, "entrypoints", compat="fixed"), "SELECT s.id, 'entrypoint' AS artifact_kind, s.name, f.path AS file_path, s.qualified_name AS symbol_name, '{}' AS data_json, 'exact' AS confidence FROM symbols s JOIN files f ON s.file_id = f.id WHERE s.symbol_kind = 'entrypoint'"),
    "list_diagnostics": (find.latest_diagnostics, "SELECT d.id, severity, code, message, coalesce(f.path, '') AS file_path, coalesce(d.line, 0) AS line, d.run_id FROM diagnostics d LEFT JOIN files f ON d.file_id = f.id WHERE d.run_id = (SELECT max(id) FROM index_runs)"),
    **{n: (lambda t, a=a, c=c, k=k: report.count_by(getattr(t, a), c, k), f"SELECT {c} AS {k}, count(*) AS n FROM {a} GROUP BY 1") for n, (a, c, k) in STATS.items()},
    "stats_totals": (report.stats, " UNION ALL ".join(
        [f"SELECT '{m}' AS metric, {c} AS key, count(*) AS n FROM {a} GROUP BY {c}" for m, a, c in (("files_by_language", "files", "language"), ("symbols_by_kind", "symbols", "symbol_kind"), ("references_by_kind", "refs", "reference_kind"), ("artifacts_by_kind", "artifacts", "artifact_kind"))]
        + [f"SELECT '{m}', '', count(*) FROM ({s})" for m, s in (("packages", "SELECT * FROM packages"), ("stale_files", STALE_F), ("stale_packages", STALE_P), ("stale_symbols", STALE_S))])),
    "last_run": (report.last_run, "SELECT id, status, mode, files_scanned, files_changed, started_at, coalesce(finished_at, '') AS finished_at, error_count, warning_count FROM index_runs ORDER BY id DESC LIMIT 1"),
    "stale_files": (report.stale_files, STALE_F),
    "stale_packages": (report.stale_packages, STALE_P),
    "stale_packages_fixed": (lambda t: report.stale_packages(t, "fixed"), STALE_P_FIXED),
    "stale_symbols": (report.stale_symbols, STALE_S),
    "stale_all": (report.stale_all, f"{STALE_F} UNION ALL {STALE_P} UNION ALL {STALE_S}"),
    "package_composite_hash": (report.composite_hashes, "SELECT pf.package_id, string_agg(f.content_hash, ':' ORDER BY f.path) AS composite_hash FROM package_files pf JOIN files f ON pf.file_id = f.id GROUP BY 1"),
    "validate_fk": (report.foreign_keys, FK_SQL),
    **{f"validate_{n}": (f, CHECK_SQL[n]) for n, f in report.CHECKS.items()},
    "validate_report": (report.validation_report, REPORT_SQL),
    "export_summary": (report.export_summary, f"""WITH last AS (SELECT * FROM index_runs ORDER BY id DESC LIMIT 1) SELECT DISTINCT 'language' AS section, language AS item, 1::BIGINT AS n FROM files
        UNION ALL SELECT 'package', name, file_count FROM ({EXP_PACK}) UNION ALL SELECT 'entrypoint', qualified_name, 1 FROM symbols WHERE symbol_kind = 'entrypoint' UNION ALL SELECT 'routes', '', count(*) FROM artifacts WHERE artifact_kind = 'route'
        UNION ALL SELECT 'errors', started_at, error_count FROM last UNION ALL SELECT 'warnings', started_at, warning_count FROM last
        UNION ALL SELECT 'stale_files', '', count(*) FROM ({STALE_F}) UNION ALL SELECT 'stale_packages', '', count(*) FROM ({STALE_P}) UNION ALL SELECT 'stale_symbols', '', count(*) FROM ({STALE_S})"""),
    "export_graph_nodes": (report.export_nodes, "SELECT s.stable_id, s.name, s.symbol_kind AS kind, f.path AS file, f.language FROM symbols s JOIN files f ON s.file_id = f.id"),
    "export_graph_edges": (report.export_edges, "SELECT coalesce(sf.stable_id, '') AS \"from\", coalesce(st.stable_id, '') AS \"to\", r.reference_kind AS kind, r.confidence FROM refs r LEFT JOIN symbols sf ON r.from_symbol_id = sf.id LEFT JOIN symbols st ON r.to_symbol_id = st.id WHERE r.from_symbol_id IS NOT NULL OR r.to_symbol_id IS NOT NULL"),
    "export_symbols": (report.export_symbols, "SELECT s.stable_id, s.name, s.qualified_name, s.symbol_kind AS kind, s.visibility, f.path AS file, coalesce(s.start_line, 0) AS start_line, coalesce(s.end_line, 0) AS end_line FROM symbols s JOIN files f ON s.file_id = f.id"),
    "export_packages": (report.export_packages, EXP_PACK),
    "export_routes": (report.export_routes, "SELECT coalesce(a.data_json ->> '$.method', '') AS method, coalesce(a.data_json ->> '$.path', '') AS path, coalesce(a.data_json ->> '$.handler', '') AS handler, f.path AS file, coalesce(s.start_line, 0) AS line, a.confidence FROM (SELECT * FROM artifacts WHERE artifact_kind = 'route' AND json_valid(data_json)) a JOIN files f ON a.file_id = f.id LEFT JOIN symbols s ON a.symbol_id = s.id"),
    "export_diagnostics": (report.export_diagnostics, "SELECT d.severity, d.code, d.message, coalesce(f.path, '') AS file, coalesce(d.line, 0) AS line FROM diagnostics d LEFT JOIN files f ON d.file_id = f.id WHERE d.run_id = (SELECT id FROM index_runs ORDER BY id DESC LIMIT 1)"),
    "resolve_references": (lambda t: maintain.resolve(t.refs, t.symbols).select("id", "to_symbol_id", "to_file_id", "is_resolved"), RESOLVE_SQL),
    "resolve_unique_only": (lambda t: maintain.resolve(t.refs, t.symbols, "fixed").select("id", "to_symbol_id", "to_file_id", "is_resolved"), RESOLVE_SQL + " AND s.n = 1"),
    "from_symbol_range_join": (lambda t: maintain.enclosing_symbols(t.refs, t.symbols), "SELECT r.id, arg_min(s.id, (s.end_line - s.start_line) * 1000000000 + s.id) AS from_symbol_id FROM refs r JOIN symbols s ON r.from_file_id = s.file_id AND r.line BETWEEN s.start_line AND s.end_line GROUP BY r.id"),
    "dedup_stable_id": (lambda t: maintain.dedup_stable_ids(t.symbols).select("id", "stable_id"), "SELECT max(id) AS id, stable_id FROM symbols GROUP BY stable_id"),
    "package_last_writer": (lambda t: maintain.upsert_packages(t.files.select(F.substring_index("path", "/", 2).alias("directory_path"), "path", F.col("package_name").alias("name"))), "SELECT regexp_extract(path, '^[^/]*/[^/]*') AS directory_path, max(path) AS path, arg_max(coalesce(package_name, '<null>'), path) AS name FROM files GROUP BY 1".replace("arg_max(coalesce(package_name, '<null>'), path)", "nullif(arg_max(coalesce(package_name, '<null>'), path), '<null>')")),
    "incremental_changed_files": (lambda t: maintain.changed_files(t.files.withColumn("content_hash", F.when(F.col("id") % 6 == 0, F.lit("new")).otherwise(F.col("content_hash"))).select("path", "content_hash"), t.files.filter("id % 10 <> 0")), "SELECT path, CASE WHEN id % 6 = 0 THEN 'new' ELSE content_hash END AS content_hash FROM files WHERE id % 6 = 0 OR id % 10 = 0"),
    "incremental_deleted_files": (lambda t: maintain.deleted_files(t.files.select("path", "id"), t.files.filter("id % 9 <> 0")), "SELECT path, id FROM files WHERE id % 9 = 0"),
    "cascade_delete_files": (lambda t: _sizes(maintain.cascade(t, "files", t.files.filter("id % 5 = 0").select(F.col("id").alias("k")))), "CASCADE"),
    "cascade_invalidate": (lambda t: _sizes(maintain.invalidate(t, t.files.filter("id % 5 = 0").select(F.col("id").alias("k")))), "INVALIDATE"),
    "summary_file": (lambda t: _joined(summaries.file_summaries(t), {"responsibilities": "responsibilities", "key_symbols": "key_symbols", "dependencies": "dependencies", "public_api": "public_api", "side_effects": "side_effects", "related_artifacts": "related_artifacts"}, "file_id", "summary_text", "generated_from_hash"), "SUMMARY_FILE"),
    "summary_package": (lambda t: _joined(summaries.package_summaries(t), {"exported_surface": "exported_surface", "internal_collaborators": "internal_collaborators", "external_dependencies": "external_dependencies"}, "package_id", "summary_text", "generated_from_hash"), "SUMMARY_PACKAGE"),
    "summary_symbol": (lambda t: _joined(summaries.symbol_summaries(t), {"intent": "intent", "inputs": "inputs", "related_symbols": "related_symbols"}, "symbol_id", "summary_text", "generated_from_hash"), "SUMMARY_SYMBOL"),
    "import_classification": (lambda t: t.refs.filter("reference_kind = 'imports' and raw_target_text is not null").select("raw_target_text").distinct().withColumn("kind", F.when(summaries.is_external(F.col("raw_target_text")), "external").otherwise("internal")), "SELECT DISTINCT raw_target_text, CASE WHEN contains(raw_target_text, '.') AND NOT starts_with(raw_target_text, 'golang.org') AND NOT starts_with(raw_target_text, 'google.golang.org') THEN 'external' ELSE 'internal' END AS kind FROM refs WHERE reference_kind = 'imports' AND raw_target_text IS NOT NULL"),
    "interface_satisfaction": (lambda t: maintain.satisfied_interfaces(
        t.symbols.filter("id % 3 <> 0").select("file_id", F.expr("qualified_name").alias("type_name"), F.expr("symbol_kind").alias("method")).unionByName(t.symbols.filter("id % 3 <> 0").select("file_id", "qualified_name", "visibility")  .toDF("file_id", "type_name", "method")),
        t.symbols.filter("id % 3 = 0").select("file_id", F.col("name").alias("interface_name"), F.col("symbol_kind").alias("method")).unionByName(t.symbols.filter("id % 6 = 0").select("file_id", "name", "visibility").toDF("file_id", "interface_name", "method"))),
        """WITH m AS (SELECT DISTINCT file_id, qualified_name AS type_name, unnest([symbol_kind, visibility]) AS method FROM symbols WHERE id % 3 <> 0), q AS (SELECT DISTINCT file_id, name AS interface_name, unnest(CASE WHEN id % 6 = 0 THEN [symbol_kind, visibility] ELSE [symbol_kind] END) AS method FROM symbols WHERE id % 3 = 0)
        SELECT DISTINCT m.file_id, m.type_name, q.interface_name FROM m JOIN q USING (file_id) WHERE NOT EXISTS (SELECT 1 FROM q q2 WHERE q2.file_id = q.file_id AND q2.interface_name = q.interface_name AND NOT EXISTS (SELECT 1 FROM m m2 WHERE m2.file_id = m.file_id AND m2.type_name = m.type_name AND m2.method = q2.method))"""),
    "nearest_preceding": (lambda t: maintain.nearest_preceding(t.refs.select("id", F.col("from_file_id").alias("file_id"), "line"), t.symbols.groupBy("file_id", F.col("start_line").alias("line")).agg(F.max("stable_id").alias("value"))), "SELECT r.id, r.from_file_id AS file_id, r.line, (SELECT arg_max(v, line) FROM (SELECT file_id, start_line AS line, max(stable_id) AS v FROM symbols GROUP BY 1, 2) s WHERE s.file_id = r.from_file_id AND s.line <= r.line) AS value FROM refs r"),
}


def _sizes(t) -> DataFrame:
    """(name, n, checksum) of each table after a change."""
    parts = []
    for name, keys in (("files", ["id"]), ("symbols", ["id"]), ("refs", ["id", "from_symbol_id", "to_symbol_id", "to_file_id"]), ("artifacts", ["id", "symbol_id"]), ("package_files", ["file_id"]), ("diagnostics", ["id", "file_id"]), ("file_summaries", ["file_id"]), ("package_summaries", ["package_id"]), ("symbol_summaries", ["symbol_id"])):
        x = getattr(t, name)
        total = sum((F.coalesce(F.sum(F.col(k) % 1_000_003), F.lit(0)) for k in keys[1:]), F.coalesce(F.sum(F.col(keys[0]) % 1_000_003), F.lit(0)))
        opened = F.count_if(~F.col("is_resolved")) if name == "refs" else F.lit(0)
        parts.append(x.agg(F.count("*").alias("n"), total.cast("long").alias("checksum"), opened.cast("long").alias("open")).select(F.lit(name).alias("name"), "n", "checksum", "open"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sizes_sql(head: str) -> str:
    def part(name: str, keys: list[str], opened: str = "0") -> str:
        return f"SELECT '{name}' AS name, count(*) AS n, ({' + '.join(f'coalesce(sum({k} % 1000003), 0)' for k in keys)})::BIGINT AS checksum, ({opened})::BIGINT AS open FROM n_{name}"

    return f"WITH {head} " + " UNION ALL ".join([part("files", ["id"]), part("symbols", ["id"]), part("refs", ["id", "from_symbol_id", "to_symbol_id", "to_file_id"], "count(*) FILTER (NOT is_resolved)"), part("artifacts", ["id", "symbol_id"]), part("package_files", ["file_id"]), part("diagnostics", ["id", "file_id"]), part("file_summaries", ["file_id"]), part("package_summaries", ["package_id"]), part("symbol_summaries", ["symbol_id"])])


_GONE_S = "gs AS (SELECT id FROM symbols WHERE file_id IN (SELECT id FROM g))"
_NULLS = "CASE WHEN {0} IN (SELECT id FROM {1}) THEN NULL ELSE {0} END AS {0}"
CASCADE_SQL = _sizes_sql(f"""g AS (SELECT id FROM files WHERE id % 5 = 0), {_GONE_S}, n_files AS (SELECT id FROM files WHERE id NOT IN (SELECT id FROM g)), n_symbols AS (SELECT id FROM symbols WHERE file_id NOT IN (SELECT id FROM g)),
    n_refs AS (SELECT id, from_symbol_id, {_NULLS.format("to_symbol_id", "gs")}, {_NULLS.format("to_file_id", "g")}, is_resolved FROM refs WHERE from_file_id NOT IN (SELECT id FROM g) AND (from_symbol_id IS NULL OR from_symbol_id NOT IN (SELECT id FROM gs))),
    n_artifacts AS (SELECT id, {_NULLS.format("symbol_id", "gs")} FROM artifacts WHERE file_id NOT IN (SELECT id FROM g)), n_package_files AS (SELECT * FROM package_files WHERE file_id NOT IN (SELECT id FROM g)),
    n_diagnostics AS (SELECT id, {_NULLS.format("file_id", "g")} FROM diagnostics), n_file_summaries AS (SELECT file_id FROM file_summaries WHERE file_id NOT IN (SELECT id FROM g)), n_package_summaries AS (SELECT package_id FROM package_summaries),
    n_symbol_summaries AS (SELECT symbol_id FROM symbol_summaries WHERE symbol_id NOT IN (SELECT id FROM gs))""")
INVALIDATE_SQL = _sizes_sql(f"""g AS (SELECT id FROM files WHERE id % 5 = 0), {_GONE_S}, n_files AS (SELECT id FROM files), n_symbols AS (SELECT id FROM symbols WHERE file_id NOT IN (SELECT id FROM g)),
    n_refs AS (SELECT id, from_symbol_id, nt AS to_symbol_id, to_file_id, is_resolved AND NOT (to_file_id IS NOT NULL AND to_file_id IN (SELECT id FROM g) AND nt IS NULL) AS is_resolved FROM (SELECT *, CASE WHEN to_symbol_id IN (SELECT id FROM gs) THEN NULL ELSE to_symbol_id END AS nt FROM refs WHERE from_file_id NOT IN (SELECT id FROM g) AND (from_symbol_id IS NULL OR from_symbol_id NOT IN (SELECT id FROM gs)))),
    n_artifacts AS (SELECT id, {_NULLS.format("symbol_id", "gs")} FROM artifacts WHERE file_id NOT IN (SELECT id FROM g)), n_package_files AS (SELECT * FROM package_files), n_diagnostics AS (SELECT id, file_id FROM diagnostics),
    n_file_summaries AS (SELECT file_id FROM file_summaries WHERE file_id NOT IN (SELECT id FROM g)), n_package_summaries AS (SELECT package_id FROM package_summaries WHERE package_id NOT IN (SELECT package_id FROM package_files WHERE file_id IN (SELECT id FROM g))),
    n_symbol_summaries AS (SELECT symbol_id FROM symbol_summaries WHERE symbol_id NOT IN (SELECT id FROM gs))""")
_SHOWN = "CASE WHEN coalesce(signature, '') <> '' THEN signature ELSE name END"
SUMMARY_FILE_SQL = f"""WITH s AS (SELECT file_id, count(*) AS n, count(*) FILTER (visibility = 'exported') AS x, string_agg(symbol_kind || ' ' || name, '; ' ORDER BY start_line, id) AS responsibilities, string_agg(name, '; ' ORDER BY start_line, id) FILTER (visibility = 'exported') AS key_symbols, string_agg({_SHOWN}, '; ' ORDER BY start_line, id) FILTER (visibility = 'exported') AS public_api FROM symbols GROUP BY 1),
    d AS (SELECT from_file_id, count(*) AS n, string_agg(v, '; ' ORDER BY v) AS v FROM (SELECT DISTINCT from_file_id, raw_target_text AS v FROM refs WHERE reference_kind = 'imports' AND raw_target_text IS NOT NULL) GROUP BY 1),
    e AS (SELECT from_file_id, string_agg(v, '; ' ORDER BY v) AS v FROM (SELECT DISTINCT from_file_id, reference_kind || ': ' || raw_target_text AS v FROM refs WHERE reference_kind IN ('registers_route', 'uses_config', 'touches_table', 'invokes_external_api') AND raw_target_text IS NOT NULL) GROUP BY 1),
    a AS (SELECT file_id, string_agg(artifact_kind || ':' || name, '; ' ORDER BY id) AS v FROM artifacts GROUP BY 1)
    SELECT f.id AS file_id, 'File ' || f.path || ' in package ' || CASE WHEN coalesce(package_name, '') = '' THEN 'unknown' ELSE package_name END || '.' || CASE WHEN s.n > 0 THEN ' Contains ' || s.n || ' symbols (' || s.x || ' exported).' ELSE '' END || CASE WHEN d.n > 0 THEN ' Imports ' || d.n || ' packages.' ELSE '' END AS summary_text,
    f.content_hash AS generated_from_hash, coalesce(s.responsibilities, '') AS responsibilities, coalesce(s.key_symbols, '') AS key_symbols, coalesce(d.v, '') AS dependencies, coalesce(s.public_api, '') AS public_api, coalesce(e.v, '') AS side_effects, coalesce(a.v, '') AS related_artifacts
    FROM files f LEFT JOIN s ON f.id = s.file_id LEFT JOIN d ON f.id = d.from_file_id LEFT JOIN e ON f.id = e.from_file_id LEFT JOIN a ON f.id = a.file_id WHERE f.parse_status = 'ok'"""
SUMMARY_PACKAGE_SQL = f"""WITH s AS (SELECT pf.package_id AS k, count(*) AS n, count(*) FILTER (visibility = 'exported') AS x, string_agg({_SHOWN}, '; ' ORDER BY name, id) FILTER (visibility = 'exported') AS v FROM package_files pf JOIN symbols s ON s.file_id = pf.file_id GROUP BY 1),
    d AS (SELECT k, string_agg(v, '; ' ORDER BY v) FILTER (ext) AS e, string_agg(v, '; ' ORDER BY v) FILTER (NOT ext) AS i FROM (SELECT DISTINCT pf.package_id AS k, raw_target_text AS v, contains(raw_target_text, '.') AND NOT starts_with(raw_target_text, 'golang.org') AND NOT starts_with(raw_target_text, 'google.golang.org') AS ext FROM refs JOIN package_files pf ON from_file_id = pf.file_id WHERE reference_kind = 'imports' AND raw_target_text IS NOT NULL) GROUP BY 1),
    h AS (SELECT pf.package_id AS k, string_agg(f.content_hash, ':' ORDER BY f.path) AS v FROM package_files pf JOIN files f ON pf.file_id = f.id GROUP BY 1)
    SELECT p.id AS package_id, 'Package ' || p.name || ' (' || p.language || '). ' || coalesce(s.n, 0) || ' symbols (' || coalesce(s.x, 0) || ' exported).' AS summary_text, coalesce(h.v, '') AS generated_from_hash, coalesce(s.v, '') AS exported_surface, coalesce(d.i, '') AS internal_collaborators, coalesce(d.e, '') AS external_dependencies
    FROM packages p LEFT JOIN s ON p.id = s.k LEFT JOIN d ON p.id = d.k LEFT JOIN h ON p.id = h.k"""
SUMMARY_SYMBOL_SQL = """WITH o AS (SELECT k, string_agg(v, '; ' ORDER BY v) AS v FROM (SELECT DISTINCT from_symbol_id AS k, raw_target_text AS v FROM refs WHERE reference_kind = 'calls' AND coalesce(raw_target_text, '') <> '') GROUP BY 1),
    b AS (SELECT k, string_agg(v, '; ' ORDER BY v) AS v FROM (SELECT DISTINCT r.to_symbol_id AS k, 'called by ' || s2.qualified_name AS v FROM refs r JOIN symbols s2 ON r.from_symbol_id = s2.id WHERE r.reference_kind = 'calls' AND s2.qualified_name <> '') GROUP BY 1)
    SELECT s.id AS symbol_id, s.visibility || ' ' || s.symbol_kind || ' ' || s.qualified_name || '.' AS summary_text, f.content_hash AS generated_from_hash, CASE WHEN coalesce(s.doc_comment, '') <> '' THEN s.doc_comment || '; ' ELSE '' END || s.visibility || ' ' || s.symbol_kind || ' (' || s.name || ')' AS intent, coalesce(s.signature, '') AS inputs,
    concat_ws('; ', o.v, b.v) AS related_symbols FROM symbols s JOIN files f ON s.file_id = f.id LEFT JOIN o ON s.id = o.k LEFT JOIN b ON s.id = b.k"""
_LATER = {"CASCADE": CASCADE_SQL, "INVALIDATE": INVALIDATE_SQL, "SUMMARY_FILE": SUMMARY_FILE_SQL, "SUMMARY_PACKAGE": SUMMARY_PACKAGE_SQL, "SUMMARY_SYMBOL": SUMMARY_SYMBOL_SQL}


# ---- functions over the plain tables

def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"))


_EXTS = [".go", ".TS", ".jsx", ".py", ".rs", ".java", ".cs", ".swift", ".lua", ".txt"]
_PATH = lambda: F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 4 == 0, "gen/").when(F.col("doc_id") % 4 == 1, "generated_").otherwise(""), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % 10 + 1).cast("int")))


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", _PATH().alias("path"))
    return p.select("doc_id", compat.language_of(F.col("path"), extended=False).alias("core"), compat.language_of(F.col("path")).alias("extended"))


def generated_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("// Code generated by x.\n"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", compat.generated_flag(_PATH(), F.encode(body, "UTF-8")).alias("is_generated"))


def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 bytes of every document, a character cut there repaired."""
    return table(spark, sf_dir, "documents").select("doc_id", compat.truncate_bytes(F.col("text"), 100).alias("short"))


def href_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), 1), " ").alias("links"))


_SQL_EXTS = ", ".join(f"'{e}'" for e in _EXTS)
_SQL_LANG = "CASE lower([{0}][doc_id % 10 + 1]) " + "{1} ELSE '' END"
#: Whole characters that fit in 97 bytes; a character cut there is one U+FFFD.
TRUNCATE_SQL = "SELECT doc_id, CASE WHEN strlen(text) > 100 THEN head || CASE WHEN strlen(head) < 97 THEN chr(65533) ELSE '' END || '...' ELSE text END AS short FROM (SELECT doc_id, text, substr(text, 1, list_max(list_filter(range(98), lambda k: strlen(substr(text, 1, k)) <= 97))::BIGINT) AS head FROM documents)"
TABLE_QUERIES = {
    "content_hash": (content_hash, "SELECT doc_id, sha256(text) AS content_hash, strlen(text)::BIGINT AS size_bytes FROM documents"),
    "language_detect": (language_detect, "SELECT doc_id, " + ", ".join(_SQL_LANG.format(_SQL_EXTS, " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in m.items())) + f" AS {n}" for n, m in (("core", compat.CORE_LANGUAGES), ("extended", compat.EXTENDED_LANGUAGES))) + " FROM documents"),
    "generated_flag": (generated_flag, "SELECT doc_id, (doc_id % 4 < 2 OR doc_id % 6 = 0 OR starts_with(text, '// Code generated')) AS is_generated FROM documents"),
    "truncate_bytes": (truncate_bytes, TRUNCATE_SQL),
    "truncate_bytes_all": (truncate_bytes, TRUNCATE_SQL),
    "href_extract": (href_extract, "SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"(/[^\"]+)\"', 1), ' ') AS links FROM pages"),
}


# ---- extraction over the sample texts: rows only, SQL can't express it

def extracted(spark: SparkSession, language: str) -> DataFrame:
    """Every record that a language's sample yields: (what, kind, name, line, confidence)."""
    path, text = SAMPLES[language]
    files = spark.createDataFrame([(path, bytearray(text.encode()), language)], "path string, content binary, language string")
    got = extract(files, "example.com/shop")
    s = got.select(F.explode("symbols").alias("x")).select(F.lit("symbol").alias("what"), F.col("x.symbol_kind").alias("kind"), F.col("x.qualified_name").alias("name"), F.col("x.start_line").alias("line"), F.col("x.visibility").alias("confidence"))
    r = got.select(F.explode("refs").alias("x")).select(F.lit("reference"), "x.reference_kind", "x.raw_target_text", "x.line", "x.confidence")
    a = got.select(F.explode("artifacts").alias("x")).select(F.lit("artifact"), "x.artifact_kind", "x.name", F.lit(0).cast("long"), "x.confidence")
    return s.union(r).union(a)


def comment_lines(spark: SparkSession, language: str) -> DataFrame:
    path, text = SAMPLES[language]
    return spark.createDataFrame([(i + 1, x, c) for i, (x, c) in enumerate(zip(text.split("\n"), code_lines(text, language)))], "line long, text string, is_code boolean")


def _generated(spark: SparkSession, sf_dir: str, templates: dict) -> DataFrame:
    """One source file for each document, in turn of each template, with the whole text as a comment."""
    d = table(spark, sf_dir, "documents")
    turn = (F.pmod("doc_id", F.lit(len(templates))) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(v[k]) for v in templates.values()]), turn)
    plain = F.translate(F.coalesce("text", F.lit("")), "\n\r\"'`*[(", "        ")
    made = lambda c: F.replace(F.replace(c, F.lit("{i}"), F.col("doc_id").cast("string")), F.lit("{text}"), plain)
    return d.select(made(pick(0)).alias("path"), F.encode(made(pick(1)), "UTF-8").alias("content"), F.element_at(F.array(*map(F.lit, templates)), turn).alias("language"))


def extract_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extractors over one source file for each document, in turn of each language, with the whole text as a comment."""
    files = _generated(spark, sf_dir, GENERATED)
    row = lambda what, kind, name, line, end: F.struct(F.lit(what).alias("what"), kind.alias("kind"), name.alias("name"), line.cast("long").alias("line"), end.cast("long").alias("end_line"))
    zero = F.lit(0)
    rows = F.concat(
        F.transform("symbols", lambda x: row("symbol", x["symbol_kind"], x["qualified_name"], x["start_line"], x["end_line"])),
        F.transform("refs", lambda x: row("reference", x["reference_kind"], x["raw_target_text"], x["line"], zero)),
        F.transform("artifacts", lambda x: row("artifact", x["artifact_kind"], x["name"], zero, zero)),
    )
    got = extract(files, "example.com/shop")
    return got.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.*")


def _sources_sql() -> str:
    rows = [(n, *line.split("|")) for n, (_, _, want) in enumerate(GENERATED.values()) for line in want.strip().split("\n")]
    values = ", ".join(f"({n}, '{what}', '{kind}', '{name}', {line}, {end})" for n, what, kind, name, line, end in rows)
    return f"SELECT doc_id, what, kind, replace(name, '{{i}}', doc_id::VARCHAR) AS name, line::BIGINT AS line, end_line::BIGINT AS end_line FROM documents JOIN (VALUES {values}) v(n, what, kind, name, line, end_line) ON doc_id % {len(GENERATED)} = n"


#: What extract_relations looks at.
RELATION_KINDS = ["migrates", "touches_table", "invokes_external_api", "tests", "implements", "migration", "sql_query", "external_service", "background_job"]


def extract_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migrations, SQL, services, jobs, tests and implementations of one source file for each document."""
    row = lambda what, kind, name, line, confidence, detail: F.struct(F.lit(what).alias("what"), kind.alias("kind"), name.alias("name"), line.cast("long").alias("line"), confidence.alias("confidence"), detail.alias("detail"))
    ends = lambda x: F.when(x["from_symbol_name"] == "", "").otherwise(F.concat(x["from_symbol_name"], F.lit(" -> "), x["to_symbol_name"]))
    rows = F.concat(
        F.transform("refs", lambda x: row("reference", x["reference_kind"], x["raw_target_text"], x["line"], x["confidence"], ends(x))),
        F.transform("artifacts", lambda x: row("artifact", x["artifact_kind"], x["name"], F.lit(0), x["confidence"], x["data_json"])),
    )
    got = extract(_generated(spark, sf_dir, RELATIONS), "example.com/shop")
    some = F.filter(rows, lambda r: r["kind"].isin(RELATION_KINDS))
    return got.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), F.explode(some).alias("r")).select("doc_id", "r.*")


def _relations_sql() -> str:
    rows = [(n, *line.split("|")) for n, (_, _, want) in enumerate(RELATIONS.values()) for line in want.strip().split("\n")]
    values = ", ".join(f"({n}, '{what}', '{kind}', '{name}', {line}, '{confidence}', '{detail}')" for n, what, kind, name, line, confidence, detail in rows)
    number = lambda c: f"replace({c}, '{{i}}', doc_id::VARCHAR) AS {c}"
    return f"SELECT doc_id, what, kind, {number('name')}, line::BIGINT AS line, confidence, {number('detail')} FROM documents JOIN (VALUES {values}) v(n, what, kind, name, line, confidence, detail) ON doc_id % {len(RELATIONS)} = n"


TABLE_QUERIES["extract_relations"] = (extract_relations, _relations_sql())
TABLE_QUERIES["extract_sources"] = (extract_sources, _sources_sql())

SAMPLE_QUERIES = {f"extract_{n}": (lambda spark, sf_dir, n=n: extracted(spark, n)) for n in SAMPLES} | {f"line_comment_filter_{n}": (lambda spark, sf_dir, n=n: comment_lines(spark, n)) for n in SAMPLES}


def queries() -> dict:
    out = {n: (lambda spark, sf_dir, f=f: f(virtual_index(spark, sf_dir))) for n, (f, _) in INDEX.items()}
    return out | {n: f for n, (f, _) in TABLE_QUERIES.items()} | SAMPLE_QUERIES


def oracle_sql() -> dict[str, str]:
    return {n: oracle(_LATER.get(s, s)) for n, (_, s) in INDEX.items()} | {n: s for n, (_, s) in TABLE_QUERIES.items()}
