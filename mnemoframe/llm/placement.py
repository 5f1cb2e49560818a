"""From a plan over piece lengths to a place for every piece."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of one length that are numbered in one group.
GROUP = 200_000


class Plan:
    """Which ranks of each length go where.

    A run says: the pieces of `length` with ranks from `rank` on, `count` of them, stand in sequences from `sequence` on, `times` of
    them side by side in each, the first at `offset`. The number of runs depends on the lengths that occur, at most the capacity, and
    not on the number of pieces.
    """

    def __init__(self) -> None:
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.used: dict[int, int] = {}

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def put(self, length: int, sequence: int, bins: int, offset: int, times: int = 1) -> None:
        """`times` pieces of `length` into each of `bins` sequences."""
        rank = self.used.get(length, 0)
        self.used[length] = rank + bins * times
        self.runs.append((length, rank, bins * times, sequence, offset, times))

    def arrays(self) -> np.ndarray:
        """(runs, 6), ordered by length and rank."""
        return np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 6)


def histogram(pieces: DataFrame) -> dict[int, int]:
    """Pieces of each length; at most as many rows as a sequence has places."""
    return {int(x["length"]): int(x["count"]) for x in pieces.groupBy("length").count().collect()}


def _ranked(pieces: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Pieces with a rank from 0 within their length; a length that many pieces have is numbered in groups."""
    counts = pieces.groupBy("length").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    # one row for each length, at most the capacity
    dealt = pieces.join(F.broadcast(counts), "length").withColumn("g", F.pmod(F.xxhash64(*key), "groups")).drop("groups")
    sizes = dealt.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("length", "g").orderBy(*key))
    numbered = dealt.withColumn("own", own)
    return numbered.join(before.select("length", "g", F.coalesce("base", F.lit(0)).alias("base")), ["length", "g"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("own", "base", "g")


def placed(pieces: DataFrame, plan: Callable[[dict[int, int], int], Plan], capacity: int, key: tuple[str, ...] = ("id", "piece", "crc")) -> DataFrame:
    """pieces with sequence_id and offset, as `plan` says for the counts of their lengths."""
    runs = plan(histogram(pieces), capacity).arrays()
    ranked = _ranked(pieces, key)
    scale = np.int64(1) << np.int64(46)
    begin = runs[:, 0] * scale + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = runs[np.searchsorted(begin, length * scale + rank, side="right") - 1] if len(length) else runs[:0]
            k = rank - r[:, 1]
            out = {n: b.column(n) for n in b.schema.names if n != "rank"}
            yield pa.record_batch(out | {"sequence_id": pa.array(r[:, 3] + k // np.maximum(r[:, 5], 1)), "offset": pa.array(r[:, 4] + k % np.maximum(r[:, 5], 1) * length)})

    schema = ", ".join(f"{n} {t}" for n, t in ranked.drop("rank").dtypes)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")
