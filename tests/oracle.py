"""Comparing a query's rows with those of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{DATA}/{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(_value(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


def difference(spark_frame, sql_frame) -> str:
    """Empty if both have the same columns and rows."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    a, b = rows_of(spark_frame), rows_of(sql_frame)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; first: {a[:1]} and {b[:1]}; only here {[x for x in a if x not in set(b)][:2]}; only there {[x for x in b if x not in set(a)][:2]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}" if bad else ""
