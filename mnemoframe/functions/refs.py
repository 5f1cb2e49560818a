"""Content-addressed references: SHA-256 over length-prefixed fields."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCOPE = ("tenant_ref", "scope_kind", "agent_ref", "relationship_ref", "session_ref")
OWNER = ("tenant_ref", "scope_kind", "agent_ref", "relationship_ref")
# field order inside every hash
SCOPE_FIELDS = ("scope_kind", "tenant_ref", "agent_ref", "relationship_ref", "session_ref")
OWNER_FIELDS = ("scope_kind", "tenant_ref", "agent_ref", "relationship_ref")


def _as_column(field: str | Column) -> Column:
    return F.col(field) if isinstance(field, str) else field


def encoded(field: str | Column) -> Column:
    """Upper-case hex of one field: 8-byte big-endian byte length, then its UTF-8 bytes."""
    c = _as_column(field)
    return F.concat(F.lpad(F.hex(F.octet_length(c).cast("bigint")), 16, "0"), F.hex(F.encode(c, "UTF-8")))


def encoded_array(array: Column) -> Column:
    """The encoded fields of an array of strings, in order."""
    return F.array_join(F.transform(array, encoded), "")


def digest(parts: Iterable[Column]) -> Column:
    """SHA-256 (hex) over already encoded parts."""
    return F.sha2(F.unhex(F.concat(*parts)), 256)


def ordered_digest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: str, tag: str, out: str) -> DataFrame:
    """One row a key (text columns): SHA-256 of ``tag`` and of the ``fields`` arrays of its rows, in order.

    Spark sorts the rows of a key on disk if need be, and they pass one after the other; only the state of the digest
    is kept, however many rows a key has. Rows of one place must be equal.
    """
    keys = list(keys)

    def put(state, text: str) -> None:
        raw = text.encode()
        state.update(len(raw).to_bytes(8, "big") + raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            for *key, parts in zip(*[b.column(c).to_pylist() for c in (*keys, fields)]):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                    put(state, tag)
                for text in parts:
                    put(state, text)
            yield table(done)
        yield table([(*now, state.hexdigest())] if now is not None else [])

    def table(done: list) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * (len(keys) + 1)
        return pa.record_batch([pa.array(c, pa.string()) for c in columns], names=[*keys, out])

    sorted_ = rows.select(*keys, *order, fields).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.mapInArrow(run, ", ".join(f"{c} string" for c in (*keys, out)))


def stable_hash(tag: str, *fields: str | Column) -> Column:
    return digest([encoded(F.lit(tag)), *[encoded(f) for f in fields]])


def episode_ref() -> Column:
    return F.concat(F.lit("episode_"), stable_hash("episode.v1", *SCOPE_FIELDS, "run_ref", "source_group_ref"))


def _short(prefix: str, full: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(full, 1, 32))


def context_ref(request_hash: Column) -> Column:
    return _short("context_", request_hash)


def outcome_ref() -> Column:
    return _short("outcome_", stable_hash(
        "outcome-event-identity.v1", *SCOPE_FIELDS, "run_ref", "source_group_ref", "source_event_ref",
        "idempotency_key"))


def delivery_ref() -> Column:
    return _short("delivery_", stable_hash("memory-delivery-receipt.v2", "tenant_ref", "idempotency_key"))


def seed_ref(job: Column, text: Column, episodes: Column, outcomes: Column) -> Column:
    """Identity of a newly formed disposition; the outcome part exists only when outcomes are cited."""
    tail = F.when(F.size(outcomes) > 0, F.concat(encoded(F.lit("OUTCOMES")), encoded_array(outcomes))).otherwise("")
    return _short("seed_", digest([
        encoded(F.lit("seed-form.v1")), *[encoded(f) for f in OWNER_FIELDS], encoded(job), encoded(text),
        encoded_array(episodes), tail]))


def recollection_ref(job: Column, application: Column, text: Column, episodes: Column) -> Column:
    return _short("recollection_", digest([
        encoded(F.lit("recollection-form.v1")), *[encoded(f) for f in OWNER_FIELDS], encoded(job),
        encoded(application), encoded(text), encoded_array(episodes)]))


def stream_ref(kind: str | Column, identity: str | Column) -> Column:
    return _short("memory_index_stream_", stable_hash("memory-index-stream.v1", "tenant_ref", kind, identity))


def operation_id(stream: Column, action: str | Column, kind: str | Column, ref: str | Column,
                 *cause: str | Column) -> Column:
    return _short("memory_index_operation_",
                  stable_hash("memory-index-operation.v1", stream, action, kind, ref, *cause))


def observe_hash() -> Column:
    """Hash of one intake request; a constitution changes the tag and adds fields."""
    base = ("source_ref", *SCOPE_FIELDS, "actor_kind", "actor_ref", "text", "run_ref", "source_group_ref", "role")
    with_constitution = (F.col("constitution_ref") != "") | (F.col("constitution_text") != "")
    return F.when(
        with_constitution,
        stable_hash("observe-request.v2", *base, F.lit("constitution.v1"), "constitution_ref", "constitution_text"),
    ).otherwise(stable_hash("observe-request.v1", *base))


def select_hash(situations: Column, budget: Column) -> Column:
    """Hash of one selection request; an evidence budget wraps the plain form under its own tag."""
    plain = [encoded(F.lit("memory-context-request.v2")),
             *[encoded(f) for f in (*SCOPE_FIELDS, "run_ref", "constitution_ref", "constitution_text")],
             encoded_array(situations)]
    wrapped = [encoded(F.lit("memory-context-request.episode-evidence.v1")), encoded(budget.cast("string")), *plain]
    return F.when(budget == 0, digest(plain)).otherwise(digest(wrapped))


def outcome_hash(deliveries: Column, related: Column) -> Column:
    body = [*[encoded(f) for f in (*SCOPE_FIELDS, "run_ref", "source_group_ref", "source_event_ref", "actor_kind",
                                   "actor_ref", "text")],
            encoded_array(deliveries), encoded(F.lit("related-sources")), encoded_array(related)]
    extra = [encoded(F.lit("constitution.v1")), encoded("constitution_ref"), encoded("constitution_text")]
    with_constitution = (F.col("constitution_ref") != "") | (F.col("constitution_text") != "")
    return F.when(with_constitution, digest([encoded(F.lit("outcome-report.v2")), *body, *extra])).otherwise(
        digest([encoded(F.lit("outcome-report.v1")), *body]))


def delivery_hash(refs: Column) -> Column:
    return digest([encoded(F.lit("memory-delivery.v2")),
                   *[encoded(f) for f in (*SCOPE_FIELDS, "run_ref", "context_ref")],
                   encoded_array(F.array_sort(refs))])


def window_hash(episodes: Column, outcomes: Column) -> Column:
    """Hash of a frozen consolidation window."""
    return digest([encoded(F.lit("consolidation-window.v2")), *[encoded(f) for f in OWNER_FIELDS],
                   encoded_array(episodes), encoded(F.lit("outcomes")), encoded_array(outcomes)])


def queue_hash(episodes: Column, outcomes: Column) -> Column:
    """Hash of a window as it is frozen in the queue."""
    return digest([encoded(F.lit("consolidation-queue-window.v1")), *[encoded(f) for f in OWNER],
                   encoded_array(episodes), encoded(F.lit("OUTCOMES")), encoded_array(outcomes)])


def version_root(ref: str | Column) -> Column:
    """Part of a version reference before its last ``@`` (the whole reference if there is none)."""
    c = _as_column(ref)
    return F.when(c.rlike("(?s)^.+@[^@]*$"), F.regexp_extract(c, "(?s)^(.+)@[^@]*$", 1)).otherwise(c)
