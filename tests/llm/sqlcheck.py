"""Compares a query with its SQL on one folder of tables."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.01"


def duck(sql: str, sf: str = SF) -> pd.DataFrame:
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c.sql(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda v: None if pd.isna(v) else float(v) if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in df.astype(object).itertuples(index=False)), key=repr)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
