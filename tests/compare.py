"""Compare a query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def tidy(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return ""
        if isinstance(x, pd.Timestamp):
            return x.isoformat()
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        try:
            return repr(round(float(x), 6) + 0.0) if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(one(x) for x in r) for r in df.itertuples(index=False))


def same(spark_df, sql: str, sf_dir: str) -> tuple[bool, str]:
    got, want = spark_df.toPandas(), duck(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = tidy(got), tidy(want)
    odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return a == b, f"{len(a)} and {len(b)} rows; {odd}"
