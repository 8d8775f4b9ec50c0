"""Registered queries against DuckDB on the smallest tables, where those are there."""

import os

import duckdb
import pytest

from tallylake import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def ordered(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 8) if isinstance(r[i], float) else r[i] for i in place) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    out = queries.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in out.collect()]
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name])
        assert sorted(out.columns) == sorted(want.columns)
        assert ordered(out.columns, rows) == ordered(want.columns, want.fetchall())
    else:
        assert rows
