"""Sequence operators that never put one whole key into one task.

A plain ``row_number``/``lag`` over ``partitionBy(key)`` sorts all rows of a key in one task. Here a
key is cut into *blocks* by a non-decreasing function of its order (a time slice, a range of sequence
numbers). Windows run inside a block, one summary row per block carries state from block to block, and
the carried state is joined back on (key, block). Only the summaries of a key meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_BLOCK = "__block"


def ranges_of(column: str | Column, width: int = 65536) -> Column:
    """Block id for an integer order column."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c / F.lit(width)).cast("bigint")


def time_slices(column: str, seconds: int = 3600) -> Column:
    """Block id for a timestamp order column."""
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def _earlier(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], block: Column,
                out: str = "rn") -> DataFrame:
    """1-based position of each row within its key."""
    cut = df.withColumn(_BLOCK, block)
    offsets = (
        cut.groupBy(*keys, _BLOCK).agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, _BLOCK, F.coalesce(F.sum("__n").over(_earlier(keys)), F.lit(0)).alias("__offset"))
    )
    local = F.row_number().over(W.partitionBy(*keys, _BLOCK).orderBy(*order))
    return (
        cut.withColumn("__local", local).join(offsets, [*keys, _BLOCK])
        .withColumn(out, (F.col("__local") + F.col("__offset")).cast("bigint"))
        .drop(_BLOCK, "__local", "__offset")
    )


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
             values: dict[str, str]) -> DataFrame:
    """``lag(1)`` of several columns; ``values`` maps output name to input column."""
    cut = df.withColumn(_BLOCK, block)
    packed = F.struct(*[F.col(v).alias(k) for k, v in values.items()])
    last = (
        cut.groupBy(*keys, _BLOCK).agg(F.max_by(packed, F.struct(*order)).alias("__last"))
        .select(*keys, _BLOCK, F.lag("__last").over(W.partitionBy(*keys).orderBy(_BLOCK)).alias("__carry"))
    )
    inside = F.lag(packed).over(W.partitionBy(*keys, _BLOCK).orderBy(*order))
    joined = cut.withColumn("__prev", inside).join(last, [*keys, _BLOCK])
    found = F.coalesce(F.col("__prev"), F.col("__carry"))
    return joined.select(*df.columns, *[found[k].alias(k) for k in values])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str,
                out: str) -> DataFrame:
    """Inclusive running sum of ``value``."""
    cut = df.withColumn(_BLOCK, block)
    carry = (
        cut.groupBy(*keys, _BLOCK).agg(F.sum(value).alias("__s"))
        .select(*keys, _BLOCK, F.coalesce(F.sum("__s").over(_earlier(keys)), F.lit(0)).alias("__carry"))
    )
    inside = F.sum(value).over(
        W.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (
        cut.withColumn("__inside", inside).join(carry, [*keys, _BLOCK])
        .withColumn(out, F.col("__inside") + F.col("__carry")).drop(_BLOCK, "__inside", "__carry")
    )


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str,
                out: str) -> DataFrame:
    """Inclusive running maximum of ``value`` (NULLs ignored)."""
    cut = df.withColumn(_BLOCK, block)
    carry = (
        cut.groupBy(*keys, _BLOCK).agg(F.max(value).alias("__m"))
        .select(*keys, _BLOCK, F.max("__m").over(_earlier(keys)).alias("__carry"))
    )
    inside = F.max(value).over(
        W.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (
        cut.withColumn("__inside", inside).join(carry, [*keys, _BLOCK])
        .withColumn(out, F.greatest(F.col("__inside"), F.col("__carry")))
        .drop(_BLOCK, "__inside", "__carry")
    )


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out by ``columns`` to all shuffle partitions, for few rows that a join multiplies: AQE would put them into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int | Column,
          out: str = "rank") -> DataFrame:
    """First ``n`` rows per key.

    With an integer ``n`` Spark runs a partial group limit before the shuffle, so every map task sends
    at most ``n`` rows of a key and a hot key stays small.
    """
    ranked = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= n)
