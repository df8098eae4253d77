"""Rows of a Spark query and of its DuckDB SQL, in one comparable form."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, (list, dict)):
            return str(x)
        if pd.isna(x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) else str(x)

    columns = sorted(frame.columns)
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False))
