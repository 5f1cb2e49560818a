"""An index table in buckets, changed by batches of operations and read through a pointer that is swapped last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.index_log import apply_index_log, valid_operations

SCHEMA = "kind string, ref string, text string"


class PointedFolder:
    """A folder whose content is what a manifest names; the pointer to the manifest is renamed as the last step of a change."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("current").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, name: str, text: str) -> None:
        out = self._files().create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, name: str) -> str | None:
        files, path = self._files(), self._path(name)
        if not files.exists(path):
            return None
        stream = files.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def manifest(self) -> dict:
        name = self._get("current")
        return json.loads(self._get(f"manifests/{name.strip()}")) if name else {}

    def swap(self, manifest: str) -> None:
        name = uuid.uuid4().hex
        self._put(f"manifests/{name}", manifest)
        self._put(f"current.{name}", name)
        fs = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        context = fs.FileContext.getFileContext(self._path("current").toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(f"current.{name}"), self._path("current"), options)


class IndexTable(PointedFolder):
    """kind, ref, text, by hash in a fixed number of buckets.

    A batch writes new files of the buckets that it touches, then a manifest that names the files of every bucket, and renames the
    pointer to it as the last step. A batch that failed before that leaves files that no manifest names; a batch that is
    repeated finds its number in the manifest and does nothing; numbers may be missing, as no batch looks for the one before. Readers hold on to the manifest
    that they opened.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        super().__init__(spark, folder)
        self.buckets = buckets

    def manifest(self) -> dict:
        """batch: the last number applied; buckets: the folder of each bucket's files, none for an empty one."""
        return super().manifest() or {"batch": -1, "buckets": {}}

    def _bucket(self):
        return F.pmod(F.xxhash64("kind", "ref"), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{x}" for x in sorted(folders)])

    def read(self) -> DataFrame:
        return self._rows(list(self.manifest()["buckets"].values()))

    def apply(self, log: DataFrame, batch: int, documents: DataFrame) -> list[int]:
        """Operations of one batch (kind, ref, action, sequence); gives the buckets that were written."""
        manifest = self.manifest()
        if batch <= manifest["batch"]:
            return []
        valid = valid_operations(log).filter("reason IS NULL").drop("reason")
        touched = sorted(x["b"] for x in valid.select(self._bucket().alias("b")).distinct().collect())  # buckets at most
        buckets = dict(manifest["buckets"])
        if touched:
            name = f"data/{batch}-{uuid.uuid4().hex}"
            old = self._rows([buckets[str(b)] for b in touched if str(b) in buckets])
            texts = documents.select("kind", "ref", "text").join(valid.select("kind", "ref").distinct(), ["kind", "ref"], "left_semi")
            rows = apply_index_log(old, valid, texts).withColumn("bucket", self._bucket())
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
            written = {x.getPath().getName() for x in self._files().listStatus(self._path(name))}
            for b in touched:
                buckets.pop(str(b), None)
                if f"bucket={b}" in written:
                    buckets[str(b)] = f"{name}/bucket={b}"
        self.swap(json.dumps({"batch": batch, "buckets": buckets}))
        return touched

    def sink(self, documents):
        """A ``foreachBatch`` function; ``documents`` gives the canonical documents of now."""

        def apply(rows: DataFrame, number: int) -> None:
            self.apply(rows, number, documents())

        return apply
