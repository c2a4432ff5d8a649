"""Comparison of a query's rows with DuckDB's for its SQL."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def cell(v):
    if not hasattr(v, "__len__") and pd.isna(v):
        return None
    if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
        return str(v)
    return round(float(v), 6)


def rows(df):
    return sorted(tuple(str(cell(x)) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark_df, sql, folder):
    a, b = spark_df.toPandas(), duck(folder).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
    return len(a)
