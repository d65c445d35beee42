"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, list | tuple) else repr(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())
    sql = entry.oracle_sql()[name]
    assert sorted(duck.sql(sql).columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(tuple(map(norm, r)) for r in duck.sql(f"select {listed} from ({sql})").fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.registry.queries()) - set(entry.registry.oracle_sql())))
def test_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
