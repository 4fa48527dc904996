"""Every query against its SQL on DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from quietlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object or str(df[c].dtype).startswith("str"):
            df[c] = df[c].map(lambda x: "null" if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else str(x))
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got, want = plain(QUERIES[name](spark, data).toPandas()), plain(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float:
            assert np.allclose(got[c], want[c].astype(float), equal_nan=True, rtol=1e-9), c
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["source", "label", "n", "docs", "distinct_values"] and df.count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
