"""The files of a source tree as a Spark data source, `lodestar_tree`: batch for scans, streaming for continuous indexing.

Spark's own file listing hides names that begin with `_` or `.`; here every file counts, and only `.git` and the state
folder are never entered. No file is opened: rows are what the folder entries say. The driver opens folders, breadth
first, until there is a subtree for every task, and the tasks walk those; filters on path and size are applied there.
Executors have to see the tree under the same path.
"""

from __future__ import annotations

import os
import re
import stat as st
import time
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

STATE_DIR = ".lodestar"
SKIPPED_FOLDERS = (".git", STATE_DIR)
#: Subtrees that the driver divides a tree into, unless the option `parts` says otherwise.
PARTS = 64
BATCH_ROWS = 4096

_SCHEMA = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64())])
_COMPARE = {LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, StringStartsWith: str.startswith, StringEndsWith: str.endswith}


def _named(name: str) -> bool:
    """Whether a name is text; others can't be written as a path of the index."""
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def file_row(root: str, path: str, follow: bool = True) -> tuple[str, int, int] | None:
    """(path, size, modification time in ns) of a file or of a link to one; None for anything else."""
    at = os.path.join(root, path)
    try:
        s = os.stat(at, follow_symlinks=follow)
    except OSError:
        return None
    if st.S_ISREG(s.st_mode) or (st.S_ISLNK(s.st_mode) and (os.path.isfile(at) or not os.path.exists(at))):
        return path, s.st_size, s.st_mtime_ns
    return None


def entries(root: str, folder: str, prune: re.Pattern | None = None) -> tuple[list[str], list[str]]:
    """Paths of the subfolders and of the other entries of a folder; one that can't be read has none."""
    folders, files = [], []
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for e in found:
                path = f"{folder}/{e.name}" if folder else e.name
                if not _named(e.name):
                    continue
                if not e.is_dir(follow_symlinks=False):
                    files.append(path)
                elif e.name not in SKIPPED_FOLDERS and not (prune and prune.search(path)):
                    folders.append(path)
    except OSError:
        pass
    return folders, files


def divided(root: str, parts: int, prune: re.Pattern | None = None) -> list[list[tuple[str, bool]]]:
    """At most `parts` lists of (folder, whether with all below it) that together hold the tree once."""
    flat, open_ = [], deque([""])
    while open_ and len(open_) < parts:
        folder = open_.popleft()
        flat.append(folder)
        open_.extend(entries(root, folder, prune)[0])
    out = [[] for _ in range(max(1, min(parts, len(flat) + len(open_))))]
    for k, job in enumerate([*((f, True) for f in open_), *((f, False) for f in flat)]):
        out[k % len(out)].append(job)
    return out


def below(root: str, folder: str, deep: bool, prune: re.Pattern | None = None) -> Iterator[tuple[str, int, int]]:
    todo = [folder]
    while todo:
        folders, files = entries(root, todo.pop(), prune)
        for path in files:
            row = file_row(root, path, follow=False)
            if row:
                yield row
        if deep:
            todo += folders


class _Jobs(InputPartition):
    def __init__(self, jobs: list[tuple[str, bool]]):
        super().__init__(None)
        self.jobs = jobs


class _Walk:
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["root"])
        self.parts = int(options.get("parts", PARTS))
        self.prune = re.compile(options["prune"]) if options.get("prune") else None
        self.wanted: list[tuple[str, str, object]] = []
        self.paths: list[str] | None = None

    def split(self) -> list[_Jobs]:
        if self.paths is not None:  # named paths are looked up, the tree is not walked
            return [_Jobs([(p, False) for p in self.paths[k :: self.parts]]) for k in range(min(self.parts, len(self.paths)))]
        return [_Jobs(jobs) for jobs in divided(self.root, self.parts, self.prune)]

    def rows(self, part: _Jobs) -> Iterator[tuple[str, int, int]]:
        if self.paths is not None:
            found = (r for p, _ in part.jobs if reachable(p) and (r := file_row(self.root, p, follow=False)))
        else:
            found = (r for folder, deep in part.jobs for r in below(self.root, folder, deep, self.prune))
        for r in found:
            value = {"path": r[0], "size_bytes": r[1], "mtime_ns": r[2]}
            if all(how(value[c], v) for c, how, v in self.wanted):
                yield r


class TreeReader(_Walk, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column with values are applied while walking; an equality or IN on path replaces the walk."""
        for f in filters:
            how = _COMPARE.get(type(f))
            if not how or len(f.attribute) != 1 or f.value is None:
                yield f
                continue
            self.wanted.append((f.attribute[0], how, f.value))
            if f.attribute[0] == "path" and type(f) in (EqualTo, In) and self.paths is None:
                self.paths = sorted({f.value} if type(f) is EqualTo else set(f.value) - {None})

    def partitions(self) -> list[_Jobs]:
        return self.split()

    def read(self, partition: _Jobs) -> Iterator[pa.RecordBatch]:
        part = []
        for row in self.rows(partition):
            part.append(row)
            if len(part) == BATCH_ROWS:
                yield _batch(part)
                part = []
        yield _batch(part)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


class TreeStreamReader(_Walk, DataSourceStreamReader):
    """Each batch is the whole listing, taken when the batch runs; the offset is only the time of the request.

    With the option `groups` a row without a path and with the number of a group as its size comes for each group.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.groups = int(options.get("groups", 0))

    def initialOffset(self) -> dict:
        return {"time": 0}

    def latestOffset(self) -> dict:
        return {"time": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[_Jobs]:
        return [*self.split(), _Jobs([])]

    def read(self, partition: _Jobs) -> Iterator[tuple]:
        if not partition.jobs:
            yield from ((None, k, None) for k in range(self.groups))
        yield from self.rows(partition)


class TreeSource(DataSource):
    """format("lodestar_tree").option("root", folder): path, size_bytes and mtime_ns of every file.

    Options: parts (subtrees to divide the tree into), prune (a regular expression for folders to leave out).
    """

    @classmethod
    def name(cls) -> str:
        return "lodestar_tree"

    def schema(self) -> str:
        return "path string, size_bytes bigint, mtime_ns bigint"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)


def reachable(path: str) -> bool:
    """Whether a walk would enter the folders of a path."""
    return not path.startswith("/") and not {"..", *SKIPPED_FOLDERS} & set(path.split("/")[:-1])


def prune_regex(exclude: list[str]) -> str:
    """A regular expression for folders of which some exclude glob (`name/**`) leaves out everything."""
    from lodestar.functions.compat import glob_to_regex

    whole = [glob_to_regex(g[:-3]) for g in exclude if g.endswith("/**") and g != "/**"]
    return "|".join(r for r in whole if r).replace("(?s)", "")


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def tree(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """Every file under root."""
    _registered(spark)
    parts = max(PARTS, 4 * spark.sparkContext.defaultParallelism)
    return spark.read.format("lodestar_tree").option("root", root).option("parts", str(parts)).option("prune", prune_regex(exclude or [])).load()


def tree_stream(spark: SparkSession, root: str, groups: int = 0) -> DataFrame:
    """A stream of whole listings."""
    _registered(spark)
    return spark.readStream.format("lodestar_tree").option("root", root).option("groups", str(groups)).load()


def stats(paths: DataFrame, root: str) -> DataFrame:
    """The same rows for a table of paths; missing ones, folders and paths that a walk would not reach give none."""
    root = os.path.realpath(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([r for p in b.column(0).to_pylist() if p is not None and reachable(p) and (r := file_row(root, p))])

    return paths.select("path").distinct().mapInArrow(run, "path string, size_bytes bigint, mtime_ns bigint")


def contents(files: DataFrame, root: str, most_bytes: int = 1 << 22) -> DataFrame:
    """files with `content`, read by the tasks; null where a file can't be read. Batches hold about most_bytes."""
    root = os.path.realpath(root)
    columns = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, size, read = 0, 0, []
            for k, path in enumerate(b.column("path").to_pylist()):
                read.append(read_file(root, path))
                size += len(read[-1] or b"")
                if size >= most_bytes or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(start, len(read)) for c in columns), pa.array(read, pa.binary())], [*columns, "content"])
                    start, size, read = k + 1, 0, []

    from pyspark.sql.types import BinaryType, StructField, StructType

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def read_file(root: str, path: str) -> bytes | None:
    try:
        with open(os.path.join(root, path), "rb") as f:
            return f.read()
    except OSError:
        return None


def mtime(ns: Column) -> Column:
    """A column of nanoseconds as a timestamp."""
    return F.timestamp_micros(F.floor(ns / 1000).cast("long"))
