"""Every registered query next to its SQL twin on the smallest given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, comparable

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["pattern_name", "severity", "findings", "total_exposed"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    want = con.execute(sql).df()
    a, b = comparable(got), comparable(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert a.equals(b)
