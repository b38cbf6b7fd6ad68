"""Compares a query with its SQL on DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return con


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (np.bool_, bool)):
        return bool(value)
    if isinstance(value, (float, np.floating)):
        return round(float(value), 9) + 0.0
    return int(value) if isinstance(value, np.integer) else value


def rows(frame: pd.DataFrame, columns: list[str]) -> list[str]:
    return sorted(repr(tuple(map(plain, r))) for r in frame[columns].itertuples(index=False))


def assert_same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)
