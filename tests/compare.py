"""Compares a query's rows with those of its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd


def views(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        return str(round(float(x), 7)) if isinstance(x, (int, float, np.number)) else str(x)

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def assert_same(spark, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), views(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
