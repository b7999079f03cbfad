"""The index's tables: columns, enum domains and foreign keys."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 1
GENERATOR_VERSION = "1"

DDL = {
    "files": "id bigint, path string, language string, package_name string, module_name string, content_hash string, size_bytes bigint, last_modified_utc string, git_commit string, is_generated boolean, parse_status string, created_at string, updated_at string",
    "packages": "id bigint, name string, import_path string, directory_path string, language string, created_at string, updated_at string",
    "package_files": "package_id bigint, file_id bigint",
    "symbols": "id bigint, file_id bigint, package_id bigint, name string, qualified_name string, symbol_kind string, visibility string, parent_symbol_id bigint, signature string, doc_comment string, start_line bigint, end_line bigint, stable_id string, created_at string, updated_at string",
    "refs": "id bigint, from_symbol_id bigint, to_symbol_id bigint, from_file_id bigint, to_file_id bigint, reference_kind string, confidence string, line bigint, column_start bigint, column_end bigint, raw_target_text string, is_resolved boolean, created_at string",
    "file_summaries": "file_id bigint, summary_text string, responsibilities array<string>, key_symbols array<string>, invariants array<string>, side_effects array<string>, dependencies array<string>, public_api array<string>, risks array<string>, related_artifacts array<string>, generated_from_hash string, generator_version string",
    "package_summaries": "package_id bigint, summary_text string, major_responsibilities array<string>, exported_surface array<string>, internal_collaborators array<string>, external_dependencies array<string>, notable_invariants array<string>, risks array<string>, generated_from_hash string, generator_version string",
    "symbol_summaries": "symbol_id bigint, summary_text string, intent array<string>, inputs array<string>, outputs array<string>, side_effects array<string>, failure_modes array<string>, invariants array<string>, related_symbols array<string>, generated_from_hash string, generator_version string",
    "artifacts": "id bigint, artifact_kind string, name string, file_id bigint, symbol_id bigint, data_json string, confidence string, created_at string, updated_at string",
    "index_runs": "id bigint, started_at string, finished_at string, status string, mode string, files_scanned bigint, files_changed bigint, files_reparsed bigint, symbols_written bigint, references_written bigint, summaries_written bigint, artifacts_written bigint, error_count bigint, warning_count bigint, git_commit string, notes string",
    "diagnostics": "id bigint, run_id bigint, file_id bigint, severity string, code string, message string, line bigint, column_start bigint, column_end bigint, details_json string, created_at string",
}

# The enum domains.
SYMBOL_KINDS = "package function method struct interface type field const var class enum entrypoint test benchmark module trait protocol".split()
EXTENDED_SYMBOL_KINDS = [*SYMBOL_KINDS, "decorator", "macro", "annotation", "extension", "typealias"]
REFERENCE_KINDS = "imports calls implements embeds extends instantiates reads writes tests registers_route uses_config touches_table migrates invokes_external_api".split()
ARTIFACT_KINDS = "route config_key migration sql_query background_job queue_consumer external_service cli_command env_var feature_flag".split()
PARSE_STATUSES = "ok error partial skipped".split()
CONFIDENCES = "exact likely heuristic".split()
SEVERITIES = "info warning error fatal".split()
RUN_STATUSES = "running success partial failed".split()

#: (child, column, parent, parent key, on delete)
FOREIGN_KEYS = [
    ("package_files", "package_id", "packages", "id", "cascade"),
    ("package_files", "file_id", "files", "id", "cascade"),
    ("symbols", "file_id", "files", "id", "cascade"),
    ("symbols", "package_id", "packages", "id", "null"),
    ("symbols", "parent_symbol_id", "symbols", "id", "null"),
    ("refs", "from_symbol_id", "symbols", "id", "cascade"),
    ("refs", "to_symbol_id", "symbols", "id", "null"),
    ("refs", "from_file_id", "files", "id", "cascade"),
    ("refs", "to_file_id", "files", "id", "null"),
    ("file_summaries", "file_id", "files", "id", "cascade"),
    ("package_summaries", "package_id", "packages", "id", "cascade"),
    ("symbol_summaries", "symbol_id", "symbols", "id", "cascade"),
    ("artifacts", "file_id", "files", "id", "cascade"),
    ("artifacts", "symbol_id", "symbols", "id", "null"),
    ("diagnostics", "run_id", "index_runs", "id", "cascade"),
    ("diagnostics", "file_id", "files", "id", "null"),
]


@dataclass(frozen=True)
class IndexTables:
    """One consistent set of index tables."""

    files: DataFrame
    packages: DataFrame
    package_files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    artifacts: DataFrame
    index_runs: DataFrame
    diagnostics: DataFrame
    file_summaries: DataFrame
    package_summaries: DataFrame
    symbol_summaries: DataFrame

    def replace(self, **new: DataFrame) -> IndexTables:
        return IndexTables(**{f.name: new.get(f.name, getattr(self, f.name)) for f in fields(self)})


TABLES = [f.name for f in fields(IndexTables)]


def empty_tables(spark: SparkSession) -> IndexTables:
    return IndexTables(**{n: spark.createDataFrame([], DDL[n]) for n in TABLES})
