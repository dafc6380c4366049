"""The driver's contract: every query that has SQL gives what DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_against_sql(spark, db, name):
    ours, sql = contract.queries()[name](spark, SF), db.sql(contract.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(sql.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=key) == sorted(sql.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=key)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_all_queries_with_sql_are_there():
    assert set(contract.oracle_sql()) <= set(contract.queries())
