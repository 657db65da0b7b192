"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from tarn.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    theirs = con.sql(queries.oracle_sql()[name])
    mine = queries.queries()[name](spark, DATA)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert sorted(map(tuple, mine.select(theirs.columns).collect()), key=str) == sorted(theirs.fetchall(), key=str)
