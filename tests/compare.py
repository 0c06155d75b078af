"""Hold a registered query against its DuckDB SQL: names, row counts and values."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]) or df[c].dtype == object and any(isinstance(v, float) for v in df[c].dropna().head(5)):
            df[c] = df[c].astype(float)
        elif df[c].dtype == object or str(df[c].dtype) in ("string", "str"):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v))
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns), kind="stable", na_position="last").reset_index(drop=True)


def differences(spark_df, sql, con):
    """What differs, or an empty string."""
    a, b = spark_df.toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    a, b = canonical(a.copy()), canonical(b.copy())
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_numeric_dtype(x) or pd.api.types.is_numeric_dtype(y):
            x, y = x.astype(float), y.astype(float)
            bad = ~((x == y) | (x.isna() & y.isna()))
        else:
            bad = ~((x.fillna("\0") == y.fillna("\0")))
        if bad.any():
            k = int(np.flatnonzero(bad)[0])
            return f"{c}: {int(bad.sum())} of {len(a)} differ, first {a.iloc[k].to_dict()} and {b.iloc[k].to_dict()}"
    return ""
