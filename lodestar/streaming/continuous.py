"""Continuous indexing: what came, changed or went in a watched folder, one indexing run for each micro-batch.

Every micro-batch lists the tree, in the tasks. A stateful operator holds what each path was when it was last seen, so
it does not matter how old a file is that was moved in, and a path that is listed no more is one that went. Paths are
dealt out into groups; a group's row of its own in every listing makes it compare also when all of its files are gone.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.plans.indexing import index_rows
from lodestar.plans.store import Store
from lodestar.sources.files import Config, module_path, stat
from lodestar.sources.tree import tree_stream

#: Groups of paths, each with a state of its own; a parameter that grows with the tree and stays for a checkpoint's life.
GROUPS = 64
#: A file that changed so shortly before it was listed may change again within the resolution of its time.
TICK_NS = 2_000_000_000

_STATE = "paths array<string>, sizes array<bigint>, times array<bigint>"
_CHANGE = "path string, what string"


def compared(listed: dict[str, tuple[int, int]], known: dict[str, tuple[int, int]], now_ns: int) -> tuple[list[tuple[str, str]], dict[str, tuple[int, int]]]:
    """What differs between a listing and the known state (path -> size, time), and the new state.

    A file whose time is about now is remembered without a time, so the next listing gives it once more.
    """
    out = [(p, "new" if p not in known else "changed") for p, v in listed.items() if known.get(p) != v]
    out += [(p, "deleted") for p in known if p not in listed]
    return out, {p: (size, at if at < now_ns - TICK_NS else -1) for p, (size, at) in listed.items()}


def _compare(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = time.time_ns()
    listed = {p: (int(s), int(t)) for part in parts for p, s, t in zip(part["path"], part["size_bytes"], part["mtime_ns"], strict=True) if p is not None}
    known = {p: (s, t) for p, s, t in zip(*state.get, strict=True)} if state.exists else {}
    out, new = compared(listed, known, now)
    state.update(([*new], [s for s, _ in new.values()], [t for _, t in new.values()]))
    yield pd.DataFrame(out, columns=["path", "what"])


def tree_changes(spark: SparkSession, root: str, groups: int = GROUPS) -> DataFrame:
    """A stream of (path, what): new, changed or deleted since the listing before."""
    listed = tree_stream(spark, root, groups)
    group = F.when(F.col("path").isNull(), F.col("size_bytes")).otherwise(F.pmod(F.xxhash64("path"), groups)).cast("int")
    return listed.withColumn("g", group).groupBy("g").applyInPandasWithState(_compare, _CHANGE, _STATE, "append", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, config: Config = Config(), available_now: bool = True, groups: int = GROUPS) -> StreamingQuery:
    """A query that feeds each batch's changes to the same scan and merge as a batch run; what went is taken out.

    A batch without changes makes no version. A batch that is run again after a failure finds the same files, and those
    that are indexed already are skipped by their hashes.
    """

    def run(batch: DataFrame, _: int) -> None:
        s = batch.sparkSession
        changes = batch.persist()
        try:
            if not changes.isEmpty():
                there = stat(s, root, changes.filter("what <> 'deleted'").select("path"), config)
                index_rows(s, there, store, config, mode="incremental", module_path=module_path(root), removed=changes.filter("what = 'deleted'").select("path"), quiet=True)
        finally:
            changes.unpersist()

    writer = tree_changes(spark, root, groups).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
