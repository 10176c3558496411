"""Every registered query against its SQL on DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from cytoplan.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else str(x) for x in row) for row in frame.itertuples(index=False)]
    return rows, list(frame.columns)


def same(x, y):
    """Equal, but for the last digits of numbers (pandas turns whole numbers beside nulls into floats)."""
    if x is None or y is None or (isinstance(x, str) and isinstance(y, str)):
        return x == y
    return abs(float(x) - float(y)) < 1e-6


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    (a, names), (b, others) = rows_of(got), rows_of(want)
    assert names == others and len(a) == len(b)
    key = lambda r: tuple(str(x if x is None or isinstance(x, str) else float(x)) for x in r)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert all(map(same, x, y)), (x, y)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
