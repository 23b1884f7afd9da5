"""Every registered query against its SQL, run by DuckDB on the same files."""

import datetime
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload import QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    yield connection
    connection.close()


def cell(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return (type(value).__name__, repr(value))


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = queries()[name](spark, SF)
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(oracle_sql()[name])
    theirs = table([d[0] for d in cursor.description], cursor.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    for a, b in zip(*[ours[1], theirs[1]]):
        assert a == b


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", ["sort_output", "sort_ci"])
def test_order_of_the_output(spark, duck, name):
    """The rows in the order of the written files, against the ORDER BY of the SQL."""
    ours = [tuple(r) for r in queries()[name](spark, SF).collect()]
    assert ours == duck.execute(oracle_sql()[name]).fetchall()


def test_window_bounds_finds_dates(spark):
    found = queries()["window_bounds"](spark, SF)
    assert found.where("start_map IS NOT NULL").count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
