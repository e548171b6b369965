"""Every registered query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from lectern.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


def test_each_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLES.keys()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, sf, con, name):
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())
