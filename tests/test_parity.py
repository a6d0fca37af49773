"""Every catalogue query that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from gristmill.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the small tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_parity(spark, sql, name):
    a, b = queries.QUERIES[name](spark, DATA).toPandas(), sql.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(a) == rows(b)
