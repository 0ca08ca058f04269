"""Spark against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def rows(df):
    """Rows of a pandas frame as sorted strings, columns by name, nulls and NaN alike."""
    df = df[sorted(df.columns)]
    missing = lambda v: v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v
    clean = lambda v: None if missing(v) else round(float(v), 9) if isinstance(v, float) else v
    return sorted(str(tuple(clean(v) for v in r)) for r in df.astype(object).itertuples(index=False, name=None))
