"""Every registered query against its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def _table(names, raw):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in at) for r in raw), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, data, oracle, name):
    df = entry.queries()[name](spark, data)
    got = _table(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = oracle.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = _table(names, result.fetchall())
    assert got == want
    assert got


def test_entry(spark):
    assert entry.entry(spark).count() == 150


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
