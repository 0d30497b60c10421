"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TINY = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) or 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(TINY).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, TINY)
    result = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    theirs = Counter(tuple(plain(dict(zip(result.columns, r, strict=True))[c]) for c in columns) for r in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, TINY).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
