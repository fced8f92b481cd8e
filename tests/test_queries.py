"""Every registered query that has SQL must give the same rows as the SQL; the others must run."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, message, _ = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["bin", "dt_lo", "events", "median_nhit", "fraction"]
    assert df.count() == 11


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
