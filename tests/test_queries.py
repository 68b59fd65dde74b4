"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from marginalia.plans.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["events", "documents"]


@pytest.fixture(scope="module")
def database():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in places], sorted((tuple(r[i] for i in places) for r in rows), key=repr)


def test_every_query_has_its_sql():
    assert QUERIES.keys() <= contract.queries().keys()
    assert QUERIES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    found = contract.queries()[name](spark, FOLDER)
    cursor = database.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    expected = ordered(columns, cursor.fetchall())
    assert expected[1]
    assert ordered(found.columns, found.collect()) == expected
