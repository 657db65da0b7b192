"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest

from tarn.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in registry.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "~"
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value).removesuffix(" 00:00:00")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_duckdb(spark, duck, name):
    mine = registry.queries()[name](spark, DATA)
    theirs = duck.sql(registry.oracle_sql()[name])
    names = sorted(theirs.columns)
    assert sorted(mine.columns) == names
    have = sorted(tuple(map(plain, r)) for r in mine.select(*[f"`{c}`" for c in names]).collect())
    want = sorted(tuple(map(plain, r)) for r in theirs.project(", ".join(f'"{c}"' for c in names)).fetchall())
    assert have == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(NAMES)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
