"""A query's rows against its SQL's rows in DuckDB."""

from __future__ import annotations

import math
import numbers
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    if isinstance(v, numbers.Number):
        v = float(v)
        return None if math.isnan(v) else int(v) if v.is_integer() else v
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def duck(sql: str, sf: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).df()


def agree(query, sql: str, spark, sf: str = SF) -> None:
    got, want = query(spark, sf).toPandas(), duck(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
