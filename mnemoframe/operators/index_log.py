"""The search index as a projection: documents, ordered log, rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import chunk_tokens, mask_episode, normalize_ws

INDEX_SCOPE = ["tenant_ref", "agent_ref", "relationship_ref"]


def index_documents(episodes: DataFrame, recollections: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Episodes, active recollections and active dispositions in enumeration order 0, 1, 2.

    ``episodes`` carry their rendered ``text``.
    """
    def part(df: DataFrame, order: int, kind: str, ref: str) -> DataFrame:
        return df.select(F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), F.col(ref).alias("ref"), *INDEX_SCOPE, "text")

    return (
        part(episodes, 0, "EPISODE", "episode_ref")
        .unionByName(part(recollections.filter("status = 'active'"), 1, "RECOLLECTION", "version_ref"))
        .unionByName(part(dispositions.filter("status = 'active'"), 2, "DISPOSITION", "version_ref")))


def valid_operations(log: DataFrame) -> DataFrame:
    """Adds ``reason`` for operations whose frozen identity is unusable."""
    known = F.col("kind").isin("EPISODE", "RECOLLECTION", "DISPOSITION")
    return log.withColumn("reason", F.when(~F.col("action").isin("UPSERT", "DELETE"), "action").when(~known, "kind").when(
        F.coalesce(F.trim("ref"), F.lit("")) == "", "ref"))


def apply_index_log(index: DataFrame, log: DataFrame, documents: DataFrame) -> DataFrame:
    """Index state after the log.

    ``index``: kind, ref, text. ``log``: kind, ref, action, sequence. Only the last operation of a document counts
    (argmax, combined before the shuffle); texts come from the current canonical documents, and an UPSERT without one
    is a no-op that keeps what is there. Applying the same log again changes nothing.
    """
    key = ["kind", "ref"]
    last = valid_operations(log).filter("reason IS NULL").groupBy(*key).agg(F.max_by("action", "sequence").alias("action"))
    canonical = documents.select(*key, F.col("text").alias("__text"))
    change = last.join(canonical, key, "left")
    merged = index.select(*key, "text").join(change, key, "full_outer")
    upsert = (F.col("action") == "UPSERT") & F.col("__text").isNotNull()
    return merged.filter(~F.coalesce(F.col("action") == "DELETE", F.lit(False))).withColumn(
        "text", F.when(upsert, F.col("__text")).otherwise(F.col("text"))).filter("text IS NOT NULL").select(*key, "text")


def rebuild_index(documents: DataFrame) -> DataFrame:
    """The whole index from canonical documents, with episode identities masked for the embedded text."""
    return documents.filter(F.trim("ref") != "").withColumn("semantic_text", mask_episode("kind", "text")).withColumn(
        "semantic_sha", F.sha2("semantic_text", 256))


def chunks(documents: DataFrame) -> DataFrame:
    """(kind, ref, chunk, text): overlapping pieces of each document's words."""
    tokens = documents.withColumn("__tok", F.split(normalize_ws("text"), " "))
    cut = tokens.select("kind", "ref", F.posexplode(chunk_tokens(F.col("__tok"))).alias("chunk", "__c"))
    return cut.select("kind", "ref", F.col("chunk").cast("bigint").alias("chunk"), F.array_join("__c", " ").alias("text"))


def rebuild_under_changes(snapshot: DataFrame, log: DataFrame, documents: DataFrame, position: int) -> DataFrame:
    """A new index, in chunks, from a snapshot at a place of the log and the operations that came while it was built.

    ``snapshot``: kind, ref, text as of ``position``. ``log``: kind, ref, action, sequence; those up to the position are in the snapshot
    already. ``documents`` are the texts of now. Of later operations only the last one of a document counts: its chunks are made anew or
    go. The snapshot's chunks of all other documents are taken as they are, so the large side is cut once and only joined
    with the few documents that changed. The result is what a replay of the whole log gives.
    """
    key = ["kind", "ref"]
    later = valid_operations(log.filter(F.col("sequence") > position)).filter("reason IS NULL").groupBy(*key).agg(F.max_by("action", "sequence").alias("action"))
    fresh = documents.join(later.filter("action = 'UPSERT'").select(*key), key, "left_semi")
    # an UPSERT of a document that is gone keeps what is there
    gone = later.filter("action = 'DELETE'").select(*key).unionByName(fresh.select(*key))
    kept = snapshot.filter(F.trim("ref") != "").join(gone, key, "left_anti")
    return chunks(kept.select(*key, "text")).unionByName(chunks(fresh.select(*key, "text")))
