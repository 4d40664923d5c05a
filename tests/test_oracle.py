"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from starloom.plans import queries as relational


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(relational.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = relational.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    answer = duck.execute(relational.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(dict(zip(names, r))[c]) for c in columns)) for r in answer.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == want


def test_rows_without_sql(spark):
    for name in relational.QUERIES.keys() - relational.ORACLE_SQL.keys():
        assert relational.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 12
    assert entry.oracle_sql().keys() <= entry.queries().keys()
