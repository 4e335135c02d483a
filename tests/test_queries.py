"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from parseq.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(repr(v) for v in r) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(catalog.ORACLE[name]).df())
