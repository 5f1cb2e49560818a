"""Consolidation windows by micro-batch, with the rows that come too late as a second output."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.session import cut_lineage
from ..plans.split import spread
from .index_table import PointedFolder
from .state import LiveWindow

_STATE = "owner string, tail string, pending string, clock long, number long"
_FLUSH = 8192
_OUT = "what string, owner string, window_no long, position long, episode_ref string, tail string, pending string, clock long, number long"


class WindowTable(PointedFolder):
    """The collecting rule (``LiveWindow``) of every owner, kept between micro-batches.

    The watermark before a batch is the latest event of all earlier batches less ``delay``. Rows behind it are listed as late and change nothing; the others
    enter their owner's window in order. After a batch all windows close that are quiet by its own watermark, also those of owners without
    new rows. State is one small row an owner. A batch writes its answers and the state of the owners that it touched as new files
    and names them as its last step; repeating it gives the same answers.
    """

    def __init__(self, spark: SparkSession, folder: str, quiet: int, delay: int, max_size: int = 32, overlap: int = 4):
        super().__init__(spark, folder)
        self.quiet, self.delay, self.max_size, self.overlap = quiet, delay, max_size, overlap

    def manifest(self) -> dict:
        """batch and latest event (microseconds) so far, the folder of the state, and each batch's answers."""
        return super().manifest() or {"batch": -1, "latest": None, "state": None, "answers": {}}

    def _read(self, name: str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if name else self.spark.createDataFrame([], schema)

    def answers(self, batch: int | None = None) -> DataFrame:
        """what (window or late), owner, window_no, position, episode_ref: of one batch or of all."""
        names = [x for n, x in self.manifest()["answers"].items() if batch is None or int(n) == batch]
        out = self.spark.read.schema(_OUT).parquet(*[f"{self.folder}/{x}" for x in names]) if names else self.spark.createDataFrame([], _OUT)
        return out.filter("what <> 'state'").select("what", "owner", "window_no", "position", "episode_ref")

    def apply(self, arrivals: DataFrame, batch: int, end: bool = False) -> DataFrame:
        """Answers to arrivals (owner, episode_ref, micros); ``end`` closes every window."""
        manifest = self.manifest()
        if batch > manifest["batch"]:
            rows = cut_lineage(arrivals.select("owner", "episode_ref", F.col("micros").cast("long").alias("micros")))
            latest = max((x for x in (manifest["latest"], rows.agg(F.max("micros")).first()[0]) if x is not None), default=None)
            mark = None if manifest["latest"] is None else manifest["latest"] - self.delay
            late = rows.filter(F.col("micros") < mark) if mark is not None else rows.filter("false")
            timely = rows.filter(F.col("micros") >= mark) if mark is not None else rows
            state = self._read(manifest["state"], _STATE)
            name = f"data/{batch}-{uuid.uuid4().hex}"
            if latest is not None:
                now = (1 << 62) if end else latest - self.delay
                # an owner's state, then its rows in order: owners pass a task one after the other, none is gathered
                held = state.select("owner", F.lit(False).alias("new"), "tail", "pending", "clock", "number", F.lit(None).cast("long").alias("micros"), F.lit(None).cast("string").alias("episode_ref"))
                came = timely.filter("micros IS NOT NULL").withColumn("new", F.lit(True))
                steps = spread(held.unionByName(came, allowMissingColumns=True), "owner").sortWithinPartitions("owner", "new", "micros", "episode_ref")
                done = steps.mapInArrow(self._walk(now), _OUT)
                none = [F.lit(None).cast(t).alias(c) for c, t in (("window_no", "long"), ("position", "long"))]
                rest = [F.lit(None).cast(t).alias(c) for c, t in (("tail", "string"), ("pending", "string"), ("clock", "long"), ("number", "long"))]
                done = done.unionByName(late.select(F.lit("late").alias("what"), "owner", *none, "episode_ref", *rest))
                done.write.parquet(f"{self.folder}/{name}")
                self._read(name, _OUT).filter("what = 'state'").select("owner", "tail", "pending", "clock", "number").write.parquet(f"{self.folder}/{name}-state")
                manifest = {"batch": batch, "latest": latest, "state": f"{name}-state", "answers": manifest["answers"] | {str(batch): name}}
            self.swap(json.dumps(manifest | {"batch": batch}))
        return self.answers(batch)

    def _walk(self, now: int):
        rule = (self.quiet, self.max_size, self.overlap)

        fields = [x.split() for x in _OUT.split(", ")]
        schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in fields])

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({f.name: list(column) for f, column in zip(schema, zip(*out))}, schema=schema)

        def answers(owner, closed) -> list[tuple]:
            return [("window", owner, number, place, ref, None, None, None, None) for number, window in closed for place, ref in enumerate(window)]

        def end(owner, live: LiveWindow) -> list[tuple]:
            out = answers(owner, live.advance(now))
            return out + [("state", owner, None, None, None, json.dumps(live.tail), json.dumps(live.pending), live.clock, live.number)]

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owner, live, out = None, None, []
            for rows in batches:
                columns = rows.to_pydict()
                for who, new, tail, pending, clock, number, at, ref in zip(*(columns[c] for c in ("owner", "new", "tail", "pending", "clock", "number", "micros", "episode_ref"))):
                    if live is None or who != owner:
                        if live is not None:
                            out += end(owner, live)
                        owner, live = who, LiveWindow(*rule)
                    if new:
                        out += answers(who, live.add(ref, at))
                    else:
                        live = LiveWindow(*rule, json.loads(tail), json.loads(pending), clock, number)
                    if len(out) >= _FLUSH:
                        yield batch(out)
                        out = []
            if live is not None:
                out += end(owner, live)
            if out:
                yield batch(out)

        return walk
