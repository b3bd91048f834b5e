"""Every query with a SQL twin gives the twin's rows at the smallest scale."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
