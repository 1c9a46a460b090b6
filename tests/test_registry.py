"""Every registered query against its SQL counterpart, on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = driver.queries(), driver.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    if name in SQL:
        cursor = duck.execute(SQL[name])
        found = [d[0] for d in cursor.description]
        assert sorted(found) == columns
        order = [found.index(c) for c in columns]
        assert Counter(tuple(r[i] for i in order) for r in cursor.fetchall()) == got
    else:
        assert got


def test_entry(spark):
    found = driver.entry(spark).collect()
    assert found and any(r.reprs for r in found)
