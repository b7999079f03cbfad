"""Native operators against DuckDB on the smallest tables."""

import pytest
from conftest import same

from lodestar.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf, duck):
    assert same(queries.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).fetchdf())
