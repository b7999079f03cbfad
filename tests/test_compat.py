"""LIKE against the standard library's SQLite, globs against a plain matcher, byte truncation, JSON."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestar.functions import compat

NAMES = ["abc", "ABC", "a_c", "a%c", "a\\c", "Éa", "éa", "a|c", "axc", "", "foo/bar"]


@pytest.mark.parametrize("needle", ["b", "A_C", "%", "\\", "É", "|", "O/B", "a%c"])
def test_contains_is_sqlite_like(spark, needle):
    con = sqlite3.connect(":memory:")
    want = {x for x in NAMES if con.execute("select ? like ?", (x, f"%{needle}%")).fetchone()[0]}
    got = {r[0] for r in spark.createDataFrame([(x,) for x in NAMES], "s string").filter(compat.contains(F.col("s"), needle)).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("**/*.go", ["a.go", "x/y/a.go"], ["a.gox"]),
        ("vendor/**", ["vendor/a", "vendor/a/b", "vendor"], ["a/vendor/b", "vendored/x"]),
        ("src/*/a?.{ts,js}", ["src/x/ab.ts", "src/x/ab.js"], ["src/x/a.ts", "src/x/y/ab.ts"]),
        ("[a-c]*.py", ["b1.py"], ["d1.py", "b/1.py"]),
        ("[!a]x", ["bx"], ["ax"]),
    ],
)
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "p string")
    assert {r[0] for r in df.filter(compat.included(F.col("p"), [glob], [])).collect()} == set(yes)


def test_bad_glob_matches_nothing_and_no_include_means_all(spark):
    df = spark.createDataFrame([("a",)], "p string")
    assert df.filter(compat.included(F.col("p"), ["[a"], [])).count() == 0
    assert df.filter(compat.included(F.col("p"), [], [])).count() == 1


def test_truncation_counts_bytes(spark):
    s = "é" * 300
    got = spark.createDataFrame([(s,), ("short",)], "s string").select(compat.truncate_bytes(F.col("s"), 100)).collect()
    assert got[1][0] == "short" and got[0][0].endswith("...") and got[0][0].startswith("é" * 48)


def test_json_escapes():
    assert compat.go_json({"b": "<&>", "a": "x"}) == '{"a":"x","b":"\\u003c\\u0026\\u003e"}'
