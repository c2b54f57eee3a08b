"""Every query that has SQL gives the same rows as DuckDB; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n in entry.plan_queries.QUERIES]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    return round(float(v), 6) + 0.0 if not isinstance(v, (list, dict, bytes)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_parity(name, spark, duck):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
