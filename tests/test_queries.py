"""Every registered query against the same query in SQL, run by another engine."""

import duckdb
import pytest

import __spark_entry__ as driver
from tributary.plans.oracle import ORACLE_SQL
from tributary.plans.queries import QUERIES

SCALE = "/root/testdata/sf0.001"
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SCALE}/{table}.parquet'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([row[i] for i in order]) for row in rows)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert driver.queries().keys() >= QUERIES.keys()
    assert driver.oracle_sql().keys() >= ORACLE_SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    df = driver.queries()[name](spark, SCALE)
    answer = oracle.execute(driver.oracle_sql()[name])
    columns = [column[0] for column in answer.description]
    found, expected = comparable(df.columns, map(tuple, df.collect())), comparable(columns, answer.fetchall())
    assert found[0] == expected[0]
    assert len(found[1]) == len(expected[1]) > 0
    assert found[1] == expected[1]


def test_entry(spark):
    assert driver.entry(spark).count() == 150
