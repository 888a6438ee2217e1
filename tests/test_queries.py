"""Every query of the library against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from millrace import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", q.queries())
def test_same_rows(spark, duck, name):
    found = q.queries()[name](spark, SF)
    if name not in q.oracle_sql():
        assert found.count() > 0
        return
    other = duck.sql(q.oracle_sql()[name])
    assert sorted(found.columns) == sorted(other.columns)
    columns = sorted(other.columns)
    mine = sorted(map(str, (tuple(r[c] for c in columns) for r in found.collect())))
    index = [other.columns.index(c) for c in columns]
    assert mine == sorted(map(str, (tuple(r[i] for i in index) for r in other.fetchall())))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_order(spark):
    found = [r.n_name for r in q.queries()["order_asc"](spark, SF).collect()]
    assert found == sorted(found) and found
