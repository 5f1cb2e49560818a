"""Run a registered query in Spark and its SQL in DuckDB and compare rows."""

from __future__ import annotations

import math

import duckdb

from mnemoframe.plans.bindings import DRIVER_TABLES


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _cell(v.item())
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str, limit: int = 3):
    """Empty string if equal, else a short description."""
    left_cols = df.columns
    left = _rows(left_cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right_cols = [d[0] for d in cur.description]
    right = _rows(right_cols, cur.fetchall())
    if sorted(left_cols) != sorted(right_cols):
        return f"columns {sorted(left_cols)} != {sorted(right_cols)}"
    if left == right:
        return "" if left else "EMPTY"
    a, b = set(map(repr, left)), set(map(repr, right))
    return (f"{sorted(left_cols)} rows {len(left)} vs {len(right)}; only spark {sorted(a - b)[:limit]}; "
            f"only sql {sorted(b - a)[:limit]}")
