"""Registered queries of files, lookups, sessions, kept tables and keyed state against their SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from skuscope.plans import catalogue, files, lookups, maintained, sessions, stateful

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalogue.QUERIES.items() if f.__module__ in {m.__name__ for m in (files, lookups, maintained, sessions, stateful)}]


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(round(float(x), 4) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, database, name):
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = database.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())
