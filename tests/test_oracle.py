"""Every SQL-checked query against DuckDB on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_as_sql(spark, sf, con, name):
    assert differences(entry.queries()[name](spark, sf), con, ORACLE[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
