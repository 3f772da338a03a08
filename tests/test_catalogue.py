"""Every query against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from evidentia.plans import catalogue

DATA = os.environ.get("EVIDENTIA_DATA", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    data = [tuple(r) for r in found.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert data
        return
    expected = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, data) == rows(expected.columns, expected.fetchall())
