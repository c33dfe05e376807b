"""Each registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def sortable(row):
    return [(value is not None, value) for value in row]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(row) for row in df.select(columns).collect()), key=sortable)
    result = tables.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    places = [names.index(column) for column in columns]
    theirs = sorted((tuple(row[i] for i in places) for row in result.fetchall()), key=sortable)
    assert ours == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 6


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
