"""Every query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from statera.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, int):
        return f"{value:.6f}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    relation = duck.sql(catalogue.ORACLE[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in places) for row in relation.fetchall())
    assert sorted(tuple(map(plain, row)) for row in frame.select(columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "ok", "mode", "gross", "deductions", "net"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
