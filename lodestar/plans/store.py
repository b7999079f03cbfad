"""Index snapshots: a manifest for each version says where the parts of each of its Parquet tables lie."""

from __future__ import annotations

import itertools
import json
import time
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.schema import DDL, GENERATOR_VERSION, SCHEMA_VERSION, TABLES, IndexTables, empty_tables

#: The columns that tell the rows of a table apart.
KEYS = {"package_files": ["package_id", "file_id"], "file_summaries": ["file_id"], "package_summaries": ["package_id"], "symbol_summaries": ["symbol_id"]}
#: The column that a table's buckets go by, and how many neighbouring values stay together; other tables are one bucket.
BUCKET_BY = {"files": ("id", 64), "symbols": ("file_id", 1), "refs": ("from_file_id", 1), "artifacts": ("file_id", 1), "file_summaries": ("file_id", 64), "symbol_summaries": ("symbol_id", 1024)}
#: Readers filter on these; rows lie sorted by them, so that statistics of pages tell which to skip.
SORTED_BY = {"refs": "reference_kind", "artifacts": "artifact_kind"}


def keys_of(table: str) -> list[str]:
    return KEYS.get(table, ["id"])


class Conflict(RuntimeError):
    """Another run has published a version in the meantime."""


@dataclass(frozen=True)
class Change:
    """What a run does to a table. gone: keys (and the bucket column) of rows that go; put: rows that replace those of
    their keys; fresh: rows with new keys, `added` of them at most."""

    gone: DataFrame | None = None
    put: DataFrame | None = None
    fresh: DataFrame | None = None
    added: int = 0

    def keys(self, table: str) -> DataFrame | None:
        """Keys and bucket column of the rows that leave their place."""
        columns = list(dict.fromkeys([*keys_of(table), *([BUCKET_BY[table][0]] if table in BUCKET_BY else [])]))
        parts = [x.select(*columns) for x in (self.gone, self.put) if x is not None]
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None

    def rows(self, like: DataFrame) -> DataFrame | None:
        parts = [x.select(*like.columns) for x in (self.put, self.fresh) if x is not None]
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None

    def applied(self, table: str, base: DataFrame) -> DataFrame:
        """The table after the change."""
        keys, rows = self.keys(table), self.rows(base)
        kept = base.join(keys.select(*keys_of(table)).distinct(), keys_of(table), "left_anti").select(*base.columns) if keys is not None else base
        return kept.unionByName(rows) if rows is not None else kept


class Draft:
    """A version in the making. Tables are independent of each other, so their jobs run side by side; frames of what is
    written can be read before the version is published. Leaving the block without commit drops everything."""

    THREADS = 4

    def __init__(self, store: Store, v: int):
        self.store, self.v, self.base = store, v, store._loaded
        self._same_version()
        self.before = store._manifest(self.base)
        self.old = dict(self.before.get("tables", {}))
        self.top = f"v={v}.{store._token}"
        self.pool = ThreadPoolExecutor(self.THREADS)
        self.jobs: dict[str, Future] = {}
        self.done = False

    def _same_version(self) -> None:
        now = max(self.store.versions(), default=0)
        if now != self.base:
            raise Conflict(f"version {now} came after {self.base}")

    def run(self, job, *args) -> Future:
        """job(*args) beside the others."""
        return self.pool.submit(job, *args)

    def put(self, table: str, change: Change | DataFrame) -> None:
        self.jobs[table] = self.run(self.store._placed, table, change, self.old.get(table), f"{self.top}/{table}")

    def frame(self, table: str) -> DataFrame:
        """A table as it will be."""
        place = self.jobs[table].result() if table in self.jobs else self.old.get(table)
        return self.store._frame(table, list(place["parts"].values())) if place else self.store.spark.createDataFrame([], DDL[table])

    def commit(self, marks: dict | None = None) -> None:
        for n in TABLES:
            if n not in self.jobs and n not in self.old:
                self.put(n, Change(fresh=self.store.spark.createDataFrame([], DDL[n])))
        places = self.old | {n: j.result() for n, j in self.jobs.items()}
        self._same_version()
        self.store._claim(self.v)
        self.store._write(f"manifest-{self.v}.json", json.dumps({"tables": places, "marks": self.before.get("marks", {}) | (marks or {})}))
        self.done = True
        self.store._expire()

    def __enter__(self) -> Draft:
        return self

    def __exit__(self, kind, error, _) -> None:
        self.pool.shutdown(wait=True, cancel_futures=True)
        if self.done:
            return
        self.store.fs.delete(self.store._p(f"{self.store.path}/{self.top}"), True)
        if isinstance(error, Exception) and not isinstance(error, Conflict):
            try:
                self._same_version()  # another run's clearing up may be what went wrong
            except Conflict as lost:
                raise lost from error


class Store:
    """Parts of tables at path/v=N.token/name/..., and manifests path/manifest-N.json; the greatest number is the current version.

    A table is divided into buckets by a hash of its file id, one for about BUCKET_ROWS rows, and the manifest names
    the part of each bucket. A run writes the buckets that its changes touch; the others, and tables that a run leaves
    as they are, stay where they lie. Diagnostics are appended.

    A manifest is written under another name and renamed when its tables are whole. No file that a reader may hold is
    replaced or deleted first, so a reader sees one version or the next one, and a writer that dies in between leaves
    the old one. Of two writers on the same version the first to claim the next number wins, the other one gets a
    Conflict and works anew on what the first has left. The last KEEP versions stay readable.
    """

    KEEP = 2
    #: Parts of an appended table before it is written as a whole again.
    MOST_PARTS = 32
    CLAIM_SECONDS = 30

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = 500_000):
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self.fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._loaded = 0
        self._token = uuid.uuid4().hex[:8]

    def _read(self, name: str) -> str | None:
        at = self._p(f"{self.path}/{name}")
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """A new file, whole or not there; raises where a file of that name is there, such as another run's manifest."""
        tmp = self._p(f"{self.path}/.{name}.{uuid.uuid4().hex[:8]}")
        out = self.fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self._p(f"{self.path}/{name}")) or not self.fs.rename(tmp, self._p(f"{self.path}/{name}")):
            self.fs.delete(tmp, False)
            raise RuntimeError(f"could not write {name}: it is there already")

    def _names(self, below: str = "") -> list[str]:
        at = self._p(f"{self.path}/{below}" if below else self.path)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))

    def init(self) -> None:
        if self._read("_schema.json") is None:
            self._write("_schema.json", json.dumps({"schema_version": SCHEMA_VERSION, "generator_version": GENERATOR_VERSION}))

    def check_version(self) -> None:
        """Raises for a store of a newer schema; a missing entry is accepted."""
        meta = json.loads(self._read("_schema.json") or "{}")
        if meta.get("schema_version", 0) > SCHEMA_VERSION:
            raise RuntimeError(f"index schema {meta['schema_version']} is newer than {SCHEMA_VERSION}")

    def version(self) -> int:
        """The current version, 0 for a new store; versions that were claimed, but have no manifest, mean a damaged store."""
        found = self.versions()
        if not found and self._names("_claims"):
            raise RuntimeError(f"{self.path} holds tables but no manifest")
        return found[-1] if found else 0

    def _manifest(self, version: int) -> dict:
        return json.loads(self._read(f"manifest-{version}.json") or "{}") if version else {}

    def manifest(self, version: int) -> dict[str, dict]:
        """Where the parts of each table lie: name -> buckets, rows (about) and the parts by bucket."""
        return self._manifest(version).get("tables", {})

    def marks(self, version: int) -> dict:
        """What a run leaves for the next one: the greatest ids given, and when the last full scan began."""
        return self._manifest(version).get("marks", {})

    def load(self, version: int | None = None) -> IndexTables:
        self.check_version()
        v = self.version() if version is None else version
        places = self.manifest(v)
        self._loaded = v
        if not places:
            return empty_tables(self.spark)
        return IndexTables(**{n: self._frame(n, list(places[n]["parts"].values())) for n in TABLES})

    def _frame(self, table: str, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(DDL[table]).parquet(*[f"{self.path}/{p}" for p in parts])

    def size_bytes(self) -> int:
        """Bytes of the current version's tables."""
        parts = [p for t in self.manifest(self.version()).values() for p in t["parts"].values()]
        return sum(self.fs.getContentSummary(self._p(f"{self.path}/{p}")).getLength() for p in parts)

    # ---- meta entries

    def get_meta(self, key: str) -> str | None:
        return json.loads(self._read(self._meta(key)) or "null") if self._meta(key) else None

    def set_meta(self, key: str, value: str) -> None:
        """Entries are numbered files; the last one counts."""
        n = max([int(x.rsplit("-", 1)[1][:-5]) for x in self._names() if x.startswith(f"meta-{key}-")], default=0)
        self._write(f"meta-{key}-{n + 1}.json", json.dumps(value))
        if n:
            self.fs.delete(self._p(f"{self.path}/meta-{key}-{n}.json"), False)

    def _meta(self, key: str) -> str:
        found = [x for x in self._names() if x.startswith(f"meta-{key}-")]
        return max(found, key=lambda x: int(x.rsplit("-", 1)[1][:-5]), default="")

    def stage(self, v: int):
        """A function that writes a frame beside the snapshot of a run and reads it again."""
        number = itertools.count(1)

        def write(df: DataFrame, name: str) -> DataFrame:
            at = f"{self.path}/_stage/{self._token}/v={v}/{next(number)}-{name}"
            df.write.mode("overwrite").parquet(at)
            return self.spark.read.schema(df.schema).parquet(at)

        return write

    def _bucket(self, table: str, buckets: int) -> Column:
        column, together = BUCKET_BY[table]
        return F.pmod(F.xxhash64(F.floor(F.col(column) / together)), buckets).cast("int")

    def _write_table(self, table: str, df: DataFrame, at: str, buckets: int) -> dict[str, str]:
        """The parts of a table: one for each bucket of the rows."""
        df = df.select(*self.spark.createDataFrame([], DDL[table]).columns)
        order = [SORTED_BY[table]] if table in SORTED_BY else []
        if buckets == 1:
            (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").parquet(f"{self.path}/{at}")
            return {"0": at}
        rows = df.withColumn("bucket", self._bucket(table, buckets)).repartition("bucket").sortWithinPartitions("bucket", *order)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{at}")
        return {n[7:]: f"{at}/{n}" for n in self._names(at) if n.startswith("bucket=")}

    def _placed(self, table: str, change: Change | DataFrame, old: dict | None, at: str) -> dict:
        """The manifest's entry of a table after a change; only buckets that it touches are written."""
        base = self._frame(table, list(old["parts"].values())) if old else self.spark.createDataFrame([], DDL[table])
        if isinstance(change, DataFrame):
            parts = self._write_table(table, change, at, 1)
            return {"buckets": 1, "rows": self._frame(table, list(parts.values())).count(), "parts": parts}
        rows = (old["rows"] if old else 0) + change.added
        want = max(1, -(-rows // self.bucket_rows)) if table in BUCKET_BY else 1
        keys = change.keys(table)
        if table not in BUCKET_BY and keys is None and old and len(old["parts"]) < self.MOST_PARTS:
            return {"buckets": 1, "rows": rows, "parts": old["parts"] | {at: self._write_table(table, change.rows(base), at, 1)["0"]}}
        if not old or old["buckets"] == 1 or not old["buckets"] <= want < 2 * old["buckets"]:
            return {"buckets": want, "rows": rows, "parts": self._whole(table, change.applied(table, base), at, want)}
        n = old["buckets"]
        marks = [x.select(self._bucket(table, n).alias("b")) for x in (keys, change.rows(base)) if x is not None]
        hit = sorted({str(r["b"]) for x in marks for r in x.distinct().collect()})  # numbers of buckets
        parts = [old["parts"][b] for b in hit if b in old["parts"]]
        touched = change.applied(table, self._frame(table, parts) if parts else self.spark.createDataFrame([], DDL[table]))
        left = {b: p for b, p in old["parts"].items() if b not in hit} | self._write_table(table, touched, at, n)
        return {"buckets": n, "rows": rows, "parts": left or self._write_table(table, base.limit(0), f"{at}-empty", 1)}

    def _whole(self, table: str, df: DataFrame, at: str, buckets: int) -> dict[str, str]:
        parts = self._write_table(table, df, at, buckets)
        return parts or self._write_table(table, df.limit(0), f"{at}-empty", 1)

    def publish(self, v: int, changes: dict[str, Change | DataFrame], marks: dict | None = None) -> None:
        """Makes version v of the loaded one: changes are Change objects or whole tables; others stay where they lie."""
        with Draft(self, v) as draft:
            for n, c in changes.items():
                draft.put(n, c)
            draft.commit(marks)

    def _claim(self, v: int) -> None:
        """Takes the number v. Between a claim and its manifest lies one small file, so a claim without one is a dead writer's."""
        try:
            self.fs.create(self._p(f"{self.path}/_claims/{v}"), False).close()
        except Py4JJavaError:
            for _ in range(self.CLAIM_SECONDS):
                if max(self.versions(), default=0) >= v:
                    raise Conflict(f"version {v} is another writer's") from None
                time.sleep(1)

    def drop_stage(self) -> None:
        self.fs.delete(self._p(f"{self.path}/_stage/{self._token}"), True)

    def _expire(self) -> None:
        """Drops manifests but the last KEEP, and tables that none of these names."""
        versions = self.versions()
        for v in versions[: -self.KEEP]:
            self.fs.delete(self._p(f"{self.path}/manifest-{v}.json"), False)
            self.fs.delete(self._p(f"{self.path}/_claims/{v}"), False)
        named = {p for v in versions[-self.KEEP :] for t in self.manifest(v).values() for p in t["parts"].values()}
        for n in self._names():
            if not n.startswith("v=") or int(n[2:].split(".")[0]) > versions[-1]:
                continue
            kept = {p for p in named if p.startswith(f"{n}/")}
            if not kept:
                self.fs.delete(self._p(f"{self.path}/{n}"), True)
                continue
            for x in self._names(n):
                inside = {p for p in kept if p == f"{n}/{x}" or p.startswith(f"{n}/{x}/")}
                if not inside:
                    self.fs.delete(self._p(f"{self.path}/{n}/{x}"), True)
                elif f"{n}/{x}" not in inside:
                    for y in self._names(f"{n}/{x}"):
                        if f"{n}/{x}/{y}" not in inside:
                            self.fs.delete(self._p(f"{self.path}/{n}/{x}/{y}"), True)

    def clear(self) -> None:
        """Forgets all tables: the next version is empty. Version numbers go on, the schema entry stays."""
        v = self.version()
        if v:
            self._loaded = 0
            self._write(f"manifest-{v + 1}.json", "{}")
            self._expire()
