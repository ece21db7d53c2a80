"""Spark rows against DuckDB rows."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if isinstance(v, (np.ndarray, list, tuple)):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else int(v) if float(v).is_integer() else float(f"{v:.9g}")
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return v


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(plain(v)) for v in r) for r in df.itertuples(index=False))


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con.execute(sql).df()
