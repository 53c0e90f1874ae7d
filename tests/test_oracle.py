"""Every registered query of the graph engine runs; those with SQL give its rows."""

import compare
import pytest

from graphloom import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return compare.database(small)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert compare.differences(df, con, SQL[name]) == ""
    else:
        assert len(df.collect()) >= 0 and df.columns


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
