"""Which extractor reads which file, and the extraction as a table function over file contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.extract import compiled, golang, web
from lodestar.sources.tree import read_file

EXTRACTORS = {
    "go": golang.go, "typescript": web.typescript, "javascript": web.typescript, "python": web.python, "rust": compiled.rust, "java": compiled.java,
    "csharp": compiled.csharp, "swift": compiled.swift, "lua": compiled.lua,
}

_S, _I = T.StringType(), T.LongType()


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


RESULT = T.StructType([
    T.StructField("path", _S), T.StructField("parse_status", _S),
    T.StructField("package", T.StructType([T.StructField(k, _S) for k in ("name", "import_path", "directory_path", "language")])),
    T.StructField("symbols", _rows(name=_S, qualified_name=_S, symbol_kind=_S, visibility=_S, parent=_S, signature=_S, doc_comment=_S, start_line=_I, end_line=_I, stable_id=_S)),
    T.StructField("refs", _rows(from_symbol_name=_S, to_symbol_name=_S, reference_kind=_S, confidence=_S, line=_I, raw_target_text=_S)),
    T.StructField("artifacts", _rows(artifact_kind=_S, name=_S, data_json=_S, confidence=_S)),
    T.StructField("diagnostics", _rows(severity=_S, code=_S, message=_S)),
])


def extract_text(path: str, content: bytes | str | None, language: str, module_path: str = "") -> dict:
    """One file. A language without extractor is skipped; an extractor that fails gives an error, never an exception."""
    text = content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) else content or ""
    empty = {"path": path, "package": None, "symbols": [], "refs": [], "artifacts": []}
    if language not in EXTRACTORS:
        return empty | {"parse_status": "skipped", "diagnostics": [{"severity": "info", "code": "UNSUPPORTED_LANGUAGE", "message": f"no extractor for {path}"}]}
    try:
        more = (module_path,) if language == "go" else ()
        return {"path": path} | EXTRACTORS[language](path, text, language, *more)
    except Exception as e:  # noqa: BLE001  one bad file must not stop a run
        return empty | {"parse_status": "error", "diagnostics": [{"severity": "error", "code": "PARSE_ERROR", "message": f"{type(e).__name__}: {e}"}]}


#: A batch of results ends after so many files, bytes of source or extracted rows.
MOST_FILES, MOST_BYTES, MOST_ROWS = 64, 1 << 20, 4096


def _in_parts(results: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part, size, rows = [], 0, 0
    for row, n_bytes in results:
        part.append(row)
        size += n_bytes
        rows += len(row["symbols"]) + len(row["refs"]) + len(row["artifacts"])
        if len(part) >= MOST_FILES or size >= MOST_BYTES or rows >= MOST_ROWS:
            yield pa.RecordBatch.from_pylist(part, schema=schema)
            part, size, rows = [], 0, 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def extract(files: DataFrame, module_path: str = "") -> DataFrame:
    """(path, content, language) rows -> RESULT rows, file by file in Arrow batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, content, language = b.columns
            results = ((extract_text(path[i].as_py(), c := content[i].as_py(), language[i].as_py(), module_path), len(c or "")) for i in range(b.num_rows))
            yield from _in_parts(results, schema)

    return files.select("path", "content", "language").mapInArrow(run, RESULT)


_PARENT_AT = T.StructField("parent_at", _I)
#: What scan says of a file: RESULT with the place of each symbol's parent among the symbols before it.
SCANNED = T.StructType([
    T.StructField("path", _S), T.StructField("language", _S), T.StructField("size_bytes", _I), T.StructField("mtime_ns", _I), T.StructField("moved", T.BooleanType()), T.StructField("is_read", T.BooleanType()), T.StructField("content_hash", _S),
    T.StructField("changed", T.BooleanType()), T.StructField("head", T.BinaryType()), RESULT["parse_status"], RESULT["package"],
    T.StructField("symbols", T.ArrayType(T.StructType([*RESULT["symbols"].dataType.elementType.fields, _PARENT_AT]))), RESULT["refs"], RESULT["artifacts"], RESULT["diagnostics"],
])


def scan_text(row: dict, content: bytes | None, module_path: str) -> dict:
    """Hash of a file's bytes and, where it differs from known_hash, what the same bytes yield."""
    out = {k: row[k] for k in ("path", "language", "size_bytes", "mtime_ns", "moved")} | {"is_read": content is not None, "changed": False, "symbols": [], "refs": [], "artifacts": [], "diagnostics": []}
    if content is None:
        return out
    out |= {"content_hash": hashlib.sha256(content).hexdigest(), "head": bytes(content[:256])}
    if out["content_hash"] == row["known_hash"]:
        return out
    got = extract_text(row["path"], content, row["language"], module_path)
    at: dict[str, int] = {}
    symbols = []
    for k, s in enumerate(got["symbols"]):
        symbols.append(s | {"parent_at": at.get(s["parent"]) if s.get("parent") else None})
        at[s["qualified_name"]] = k
    return out | got | {"changed": True, "symbols": symbols}


def scan(files: DataFrame, from_disk: bool, module_path: str = "") -> DataFrame:
    """(path, language, size_bytes, mtime_ns, moved, known_hash) rows -> SCANNED rows; each file is opened once, by the task.

    Contents are read below the folder in column `root`, or else stand in column `content`. A file that can't be read
    has no hash and nothing else.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SCANNED)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                content = read_file(row["root"], row["path"]) if from_disk else row["content"]
                yield scan_text(row, content, module_path), len(content or b"")

    columns = ["path", "language", "size_bytes", "mtime_ns", "moved", "known_hash", "root" if from_disk else "content"]
    return files.select(*columns).mapInArrow(lambda batches: _in_parts(results(batches), schema), SCANNED)
