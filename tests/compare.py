"""Order-insensitive comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import hashlib

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(s: pd.Series) -> str:
    if s.dtype.kind in "iu":
        return "int"
    if s.dtype.kind == "f":
        return "float"
    if s.dtype.kind == "b":
        return "bool"
    if s.dtype.kind == "M":
        return "time"
    sample = next((v for v in s if v is not None), None)
    return type(sample).__name__


def fingerprint(df: pd.DataFrame) -> tuple[int, tuple, str]:
    df = df[sorted(df.columns)]
    kinds = tuple((c, _kind(df[c])) for c in df.columns)
    rows = sorted("|".join(repr(v) if not isinstance(v, float) else repr(float(v)) for v in row)
                  for row in df.astype(object).where(df.notna(), None).itertuples(index=False))
    return len(df), kinds, hashlib.sha256("\n".join(rows).encode()).hexdigest()
