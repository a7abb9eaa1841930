"""Comparing a query with its SQL over one data directory."""

import math
import os

import duckdb
import numpy as np
import pandas as pd


def connect(data: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(data):
        path = os.path.join(data, f)
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else round(float(v), 6)
    return str(v)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)
