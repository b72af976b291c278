"""Every query with SQL against DuckDB, at the smallest scale; the others run and keep one row for each client."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from weftline import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "events"]
LONG = {"feature_set_BureauFeaturesAntonovaCleaned", "feature_set_PreviousApplicationFeaturesAntonovaCleaned"}  # minutes of compiling


def rows(df) -> list[tuple]:
    cols = sorted(df.columns)

    def plain(v):
        if pd.isna(v):
            return "NULL"
        return v if isinstance(v, str) else f"{float(v):.5g}"

    return sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {t} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - LONG))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(found) == found["SK_ID_CURR"].nunique() > 0
        return
    expected = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
