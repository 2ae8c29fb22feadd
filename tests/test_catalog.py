"""Every catalog query against its SQL definition, on whole small tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

from conftest import TESTDATA

from forgeatlas.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for file in Path(TESTDATA).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cut = [tuple(row[i] for i in order) for row in rows]
    return sorted(cut, key=lambda row: [(v is None, str(v)) for v in row])


def test_every_query_has_a_definition():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, TESTDATA)
    result = sql.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _sorted(df.columns, df.collect()) == _sorted(columns, result.fetchall())


def test_entry(spark):
    if not os.path.isdir(TESTDATA):
        pytest.skip("no test data")
    df = entry_module.entry(spark)
    assert df.columns == ["host", "repositories"] and df.count() > 0
