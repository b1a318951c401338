"""Every query with SQL gives the rows of that SQL on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def norm(x):
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def library():
    from palimpsest.plans import queries as q

    return sorted(q.queries())


@pytest.mark.parametrize("name", library())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    assert got or sql
    if sql:
        want = duck.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
