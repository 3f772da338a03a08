"""The queries that SQL can express against DuckDB, on whole tables."""

import glob
import os

import duckdb
import pytest

from evidentia.llm import queries
from tests.test_catalogue import rows

DATA = os.environ.get("EVIDENTIA_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found, expected = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())
