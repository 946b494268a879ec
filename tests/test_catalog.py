"""Every registered query against its SQL twin on the smallest data set."""

import os

import pytest

from tidemark import catalog
from tools.check import TABLES, rows_of

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, connection, name):
    df = catalog.queries()[name](spark, FOLDER)
    rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows == rows_of(columns, cursor.fetchall())


def test_queries_without_sql_are_the_known_ones():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"a3_verify_content_hash", "g9_fit_and_score", "h12_out_of_fold_stack"}
