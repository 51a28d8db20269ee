"""Every registered query with SQL agrees with DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as registered
from check import TABLES, canonical


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def test_entry(spark):
    frame = registered.entry(spark)
    assert frame.count() == 50 and "link_count" in frame.columns


def test_every_oracle_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, folder, db, name):
    frame = registered.queries()[name](spark, folder)
    found = db.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert canonical(frame.collect(), frame.columns) == canonical(found.fetchall(), columns)


@pytest.mark.parametrize("name", ["text_blocks", "feature_table"])
def test_query_gives_rows(spark, folder, name):
    assert not registered.queries()[name](spark, folder).isEmpty()
