"""Every catalogue query with a SQL counterpart, on the smallest supplied data."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from ferrowatch.plans import catalogue, oracle

DIRECTORY = Path("/root/testdata/sf0.001")
SQL = oracle.oracle_sql()
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def second_engine():
    connection = duckdb.connect()
    for file in DIRECTORY.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda row: [(value is not None, str(value)) for value in row])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, second_engine, name):
    frame = QUERIES[name](spark, str(DIRECTORY))
    columns = sorted(frame.columns)
    actual = [tuple(row[column] for column in columns) for row in frame.collect()]
    result = second_engine.execute(SQL[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    expected = [tuple(row[i] for i in order) for row in result.fetchall()]
    assert _sorted(actual) == _sorted(expected)


def test_every_query_without_sql_is_deliberate():
    trained = {"train_alert", "train_need", "train_item", "confusion_need", "importance_need", "sample_need"}
    assert {"saved_need", "walked_need", "importance_checks_need", "predicted_by_given_nodes"} <= set(SQL)
    assert set(QUERIES) - set(SQL) == trained
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert {row["alert"] for row in entry_points.entry(spark).collect()} == {"Normal", "Warning", "Danger"}
