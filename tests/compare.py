"""Compares a Spark result with SQL over the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def tables(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if not hasattr(v, "shape") and not isinstance(v, (list, tuple)) and pd.isna(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return v


def rows(frame: pd.DataFrame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(plain(x) for x in r) for r in frame[cols].itertuples(index=False)), key=repr)
