"""Registered queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Integers as 64 bit, the type both engines share."""
    small = {f.name: F.col(f.name).cast("bigint") for f in df.schema.fields if f.dataType.typeName() in ("integer", "short", "byte")}
    return df.withColumns(small) if small else df


def wide_checks(counts: dict[str, tuple[str, ...]]) -> None:
    """Cast the named integer columns of checks to 64 bit."""
    for name, columns in counts.items():
        casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)
        CHECKS[name] = f"SELECT * REPLACE ({casts}) FROM (\n{CHECKS[name]}\n)"


def query(name: str, check: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with the SQL that must give equal rows."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: _wide(fn(Tables(spark, folder)))
        if check is not None:
            CHECKS[name] = check
        return fn

    return wrap
