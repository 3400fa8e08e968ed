"""Run a registered query on Spark and its twin on DuckDB and compare values and types."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("f", float(f"{value:.9g}") + 0.0)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, decimal.Decimal):
        return ("d", str(value.normalize()))
    if isinstance(value, datetime.datetime):
        return ("ts", value.replace(tzinfo=None).isoformat())
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, norm(v)) for k, v in value.items()))
    return value if value is None else (type(value).__name__, str(value))


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(norm(row[i]) for i in order) for row in rows), key=repr)


def compare(df, con, sql) -> str | None:
    """None when equal, else a short description of the first difference."""
    left_cols, left = canon(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right_cols, right = canon([d[0] for d in result.description], result.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} / {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}; {left[:1]} / {right[:1]}"
    if not left:
        return "both empty"
    for a, b in zip(left, right):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(left_cols, a, b) if x != y]
            return f"{sum(x != y for x, y in zip(left, right))} rows differ, first: {diff} in {a[:4]}"
    return None
