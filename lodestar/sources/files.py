"""File sources: directory walk, path list, version-control diff, settings."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.compat import included, language_of
from lodestar.sources.tree import STATE_DIR, stats, tree

__all__ = ["STATE_DIR", "Config", "diff_files", "head_commit", "listing", "load_config", "module_path", "on_disk", "repository_root", "stat", "walk"]
# Default globs.
INCLUDE = ["**/*.go", "**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.py", "**/*.pyi", "**/*.rs", "**/*.java", "**/*.cs", "**/*.swift", "**/*.lua"]
EXCLUDE = ["vendor/**", "node_modules/**", ".git/**", "testdata/**", "__pycache__/**", "target/**", ".venv/**", "venv/**", "build/**", "bin/**", "obj/**", ".build/**", "Packages/**"]
MAX_SIZE = 1 << 20


@dataclass(frozen=True)
class Config:
    include: list[str] = field(default_factory=lambda: list(INCLUDE))
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    max_size: int = MAX_SIZE
    extended_languages: bool = True
    compat: str = "reference"
    summaries: bool = True
    summary_kinds: list[str] = field(default_factory=lambda: ["file", "package", "symbol"])


def load_config(path: str) -> Config:
    """Settings from a YAML file over the defaults; a missing file gives the defaults."""
    if not os.path.exists(path):
        return Config()
    import yaml

    with open(path) as f:
        given = yaml.safe_load(f) or {}
    return config_of(given)


def config_of(given: dict) -> Config:
    """Settings as users write them: in sections (indexing, summaries) or flat. A section's `enabled` is its switch."""
    section = lambda name: x if isinstance(x := given.get(name), dict) else {}
    indexing, on = section("indexing"), section("summaries")
    found = {k: v for k, v in given.items() if k in Config.__dataclass_fields__ and not isinstance(v, dict)}
    found |= {k: indexing[o] for k, o in (("include", "include"), ("exclude", "exclude"), ("max_size", "max_file_size_bytes")) if o in indexing}
    found |= {k: given[o] for k, o in (("max_size", "max_file_size_bytes"),) if o in given}
    if on:
        found["summaries"] = bool(on.get("enabled", True))
        found["summary_kinds"] = [k for k in ("file", "package", "symbol") if on.get(k, True)]
    return Config(**found)


def _candidates(files: DataFrame, root: str, c: Config) -> DataFrame:
    """Listed files -> path, size_bytes, mtime_ns, language and root of those that the settings ask for."""
    rows = files.filter(F.col("size_bytes") <= c.max_size) if c.max_size > 0 else files
    rows = rows.withColumn("language", language_of(F.col("path"), c.extended_languages))
    return rows.filter((F.col("language") != "") & included(F.col("path"), c.include, c.exclude)).withColumn("root", F.lit(os.path.realpath(root)))


def walk(spark: SparkSession, root: str, c: Config = Config()) -> DataFrame:
    """Candidate files of a tree, by their folder entries; no file is opened. Folders that are excluded whole are not entered."""
    return _candidates(tree(spark, os.path.realpath(root), c.exclude), root, c)


def listing(candidates: DataFrame) -> DataFrame:
    """Paths of candidates as listed, also of files that turn out to be unreadable."""
    return candidates.select("path")


def on_disk(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files under root, relative to it, from the listing alone."""
    return tree(spark, os.path.realpath(root)).select("path")


def stat(spark: SparkSession, root: str, paths: DataFrame | list[str], c: Config = Config()) -> DataFrame:
    """The same rows as walk for given paths; missing ones and folders give none."""
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame([(p,) for p in paths], "path string")
    return _candidates(stats(paths, root), root, c)


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=60).stdout.strip()


def head_commit(root: str) -> str:
    try:
        return _git(root, "rev-parse", "HEAD")
    except (subprocess.SubprocessError, OSError):
        return ""


def diff_files(root: str, since: str) -> list[str]:
    """Paths that changed since a revision; an error stops the run."""
    return [x for x in _git(root, "diff", "--name-only", since).split("\n") if x]


def module_path(root: str) -> str:
    at = os.path.join(root, "go.mod")
    if not os.path.exists(at):
        return ""
    with open(at) as f:
        return next((x[7:].strip() for x in f if x.startswith("module ")), "")


def repository_root(given: str = "", start: str = ".") -> str:
    """The given root, else the nearest folder upwards that holds a .git folder, else the start."""
    if given:
        return os.path.realpath(given)
    at = os.path.realpath(start)
    while at != os.path.dirname(at):
        if os.path.isdir(os.path.join(at, ".git")):
            return at
        at = os.path.dirname(at)
    return os.path.realpath(start)
