"""Every catalog query with DuckDB text gives the same rows there, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, duck, sf_dir, name):
    ok, message = check(spark, duck, sf_dir, name, QUERIES[name], ORACLES[name])
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
