"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import decimal
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        v = float(v)
        return None if v != v else int(v) if v == int(v) else round(v, 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return v


def rows(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df[names].itertuples(index=False)), key=lambda r: [str(x) for x in r])


def by_sql(sql: str, sf: str = SF) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return rows(con.execute(sql).df())
