"""Running bounded streams to their end and index maintenance by micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.session import shared_folder
from .index_table import IndexTable
from .state import ROCKSDB


def run_available(stream: DataFrame) -> DataFrame:
    """Process what is there now, then read the appended result back from the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", folder + "/rows")
            .option("checkpointLocation", folder + "/progress").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(folder + "/rows")


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A driver table as a stream of files."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path + "*")


def index_sink(spark: SparkSession, table: str, documents, buckets: int = 256):
    """``foreachBatch`` function that keeps an index table (``IndexTable``) up to date from a log stream.

    ``documents`` returns the current canonical documents. Only buckets that a batch touches are written.
    """
    return IndexTable(spark, table, buckets).sink(documents)
