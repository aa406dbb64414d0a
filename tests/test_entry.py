"""The driver's contract over the smallest tables: every engine query has the rows of its SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from rastermill.plans import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def ordered(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    got = ordered(engine.QUERIES[name](spark, DATA).toPandas())
    if name not in engine.ORACLE_SQL:
        assert len(got)
        return
    want = ordered(sql.sql(engine.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[c][~same].head().tolist(), want[c][~same].head().tolist(), np.flatnonzero(~same)[:5])
