"""Every index query against DuckDB on the smallest tables."""

import pytest
from conftest import same
from pyspark.sql import functions as F

from lodestar import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf, duck):
    got = queries.queries()[name](spark, sf).toPandas()
    assert same(got, duck.execute(SQL[name]).fetchdf()), name


def test_entry_has_rows(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_but_the_samples_has_sql():
    assert set(SQL) | set(queries.SAMPLE_QUERIES) == set(queries.queries())


@pytest.mark.parametrize("name", ["extract_go", "extract_java", "line_comment_filter_python"])
def test_samples_have_rows(name, spark):
    assert queries.queries()[name](spark, "").count() > 5


def test_truncation_of_every_document_against_byte_slices(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.queries()["truncate_bytes_all"](spark, sf).collect()
    want = {i: t if len(t.encode()) <= 100 else t.encode()[:97].decode(errors="replace") + "..." for i, t in texts.items()}
    assert len(rows) == len(texts) and {r["doc_id"]: r["short"] for r in rows} == want
    assert any("\ufffd" in x for x in want.values())


@pytest.mark.parametrize("pad", range(90, 102))
def test_a_cut_character_is_repaired(pad, spark):
    from lodestar.functions.compat import truncate_bytes

    texts = [(("x" * pad + c * 9),) for c in ("é", "€", "😀", "e\u0301")] + [(None,)]
    df = spark.createDataFrame(texts, "t string")
    got = [r[0] for r in df.select(truncate_bytes(df["t"], 100)).collect()]
    assert got == [t and (t if len(t.encode()) <= 100 else t.encode()[:97].decode(errors="replace") + "...") for (t,) in texts]


@pytest.mark.parametrize("name", ["stale_packages_fixed", "list_entrypoints"])
def test_former_empty_results_have_rows(name, spark, sf):
    assert 0 < queries.queries()[name](spark, sf).count()


def test_fuzzy_search_folds_ascii_letters_only(spark, sf):
    from lodestar.operators.find import find_symbol
    from lodestar.plans.virtual import virtual_index

    t = virtual_index(spark, sf)
    one = t.symbols.limit(1).withColumns({"name": F.lit("École"), "qualified_name": F.lit("a.École")})
    one = t.replace(symbols=one, files=t.files.join(one.select(F.col("file_id").alias("id")), "id").select(*t.files.columns))
    hits = lambda x: find_symbol(one, x, fuzzy=True).count()
    assert hits("Éco") == hits("ÉCO") == 1 and hits("éco") == 0


ORDERS = {
    "who_calls": "ORDER BY confidence, from_file, line", "touches": "ORDER BY from_file, line",
    "list_diagnostics": "ORDER BY severity, file_path, line",
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_order_of_rows(name, spark, sf, duck):
    keys = [x.strip() for x in ORDERS[name][9:].split(",")]
    got = [tuple(r[k] for k in keys) for r in queries.queries()[name](spark, sf).collect()]
    want = duck.execute(f"SELECT {', '.join(keys)} FROM ({SQL[name]}) {ORDERS[name]}").fetchall()
    assert len(got) > 1 and got == want


def test_order_of_found_symbols(spark, sf):
    from lodestar.operators.find import KIND_RANK, MATCHES
    from lodestar.plans.virtual import virtual_index

    t = virtual_index(spark, sf)
    at = {r["id"]: r["updated_at"] for r in t.files.collect()}
    rows = queries.queries()["find_symbol_fuzzy"](spark, sf).collect()
    key = lambda r: (MATCHES.index(r["match_type"]), r["visibility"] != "exported", KIND_RANK.get(r["symbol_kind"], 0), [-ord(c) for c in at[r["file_id"]]], r["id"])
    assert len(rows) > 1 and rows == sorted(rows, key=key)
