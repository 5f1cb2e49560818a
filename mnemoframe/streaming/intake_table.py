"""Online intake by micro-batch: what earlier batches accepted is a table, which later ones look up by key, source and group."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.intake import GROUP, HEAD, SOURCE_KEY, hashed_requests, request_receipts, settle, well_formed
from ..plans.session import cut_lineage
from .index_table import PointedFolder

STATE = [*GROUP, "source_ref", "role", "idempotency_key", "arrival", "request_hash", "payload_hash", "row"]


class IntakeTable(PointedFolder):
    """Accepted requests of all batches so far, without texts.

    Requests must come in the order of arrival from batch to batch; inside a batch they may stand in any order. Key, source and link of a refused request are free for later ones, in its batch
    and after it, as only accepted requests are kept. A batch reads the accepted requests that share a key, a source or a
    group with it, decides its own by the rounds of ``settle``, writes those it accepted as new files and names them in
    the manifest as its last step. A repeated batch gives the same answers and adds nothing.
    """

    def state(self, before: int | None = None) -> DataFrame:
        """Accepted requests, of batches before a number only."""
        folders = [x for number, x in self.manifest().get("batches", {}).items() if before is None or int(number) < before]
        schema = ", ".join(f"{c} {'long' if c in ('arrival', 'row') else 'string'}" for c in STATE)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{x}" for x in sorted(folders)]) if folders else self.spark.createDataFrame([], schema)

    def apply(self, requests: DataFrame, batch: int) -> DataFrame:
        """tenant_ref, idempotency_key, arrival, status, episode_ref of every request of the batch."""
        manifest = self.manifest()
        base = F.lit(batch).cast("bigint") * F.lit(1 << 48)
        checked = hashed_requests(requests).withColumn("row", base + F.col("row")).withColumn("at", F.struct("arrival", "request_hash", "row"))
        valid = cut_lineage(well_formed(checked))
        known = self.state(batch)
        near = [known.join(valid.select(*on).distinct(), on, "left_semi") for on in (HEAD, SOURCE_KEY, GROUP)]
        old = near[0].unionByName(near[1]).unionByName(near[2]).distinct().withColumn("at", F.struct("arrival", "request_hash", "row")).withColumn("refusal", F.lit(None).cast("string"))
        both = cut_lineage(valid.unionByName(old))
        status = cut_lineage(both.join(settle(both), "row"))
        own = valid.select("row").unionByName(checked.filter("reason IS NOT NULL").select("row"))
        answers = cut_lineage(request_receipts(status, checked).join(own, "row", "left_semi").drop("row"))
        batches = dict(manifest.get("batches", {}))
        if str(batch) not in batches:
            name = f"data/{batch}-{uuid.uuid4().hex}"
            taken = status.filter("status = 'accepted'").join(valid.select("row"), "row", "left_semi")
            taken.select(*STATE).write.parquet(f"{self.folder}/{name}")
            batches[str(batch)] = name
            self.swap(json.dumps({"batches": batches}))
        return answers


def intake_table(spark: SparkSession, folder: str) -> IntakeTable:
    return IntakeTable(spark, folder)
