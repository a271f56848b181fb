"""Every registered query against its SQL twin on the small tables."""

import pytest

import __spark_entry__ as entry_points
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    r = compare(spark, con, SF, QUERIES[name], SQL.get(name))
    assert r["problem"] in (None, "both empty"), r["problem"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["site_id", "sensor", "n_windows", "n_frozen", "mean_value"]
    assert df.count() > 0
