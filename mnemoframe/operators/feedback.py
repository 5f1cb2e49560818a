"""Deliveries, outcomes and the feedback they give to dispositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import refs
from ..plans.session import cut_lineage
from .intake import GROUP, HEAD, SCOPE, in_order, payload_hash, settle, validate_deliveries, validate_outcomes

RUN = [*SCOPE, "run_ref"]
CONTEXT = ["tenant_ref", "context_ref"]


def claimed_refs(contexts: DataFrame, items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every reference a context shows, with its kind; a reference of two kinds has ``ambiguous``."""
    shown = (
        items.select(*CONTEXT, "memory_ref", F.col("item_kind").alias("kind"))
        .unionByName(contexts.filter("constitution_ref <> ''").select(
            *CONTEXT, F.col("constitution_ref").alias("memory_ref"), F.lit("constitution").alias("kind")))
        .unionByName(evidence.select(*CONTEXT, F.col("episode_ref").alias("memory_ref"),
                                     F.lit("episode_evidence").alias("kind"))))
    return shown.groupBy(*CONTEXT, "memory_ref").agg(
        F.min("kind").alias("kind"), (F.min("kind") != F.max("kind")).alias("ambiguous"))


def admit_deliveries(deliveries: DataFrame, contexts: DataFrame, items: DataFrame, evidence: DataFrame,
                     acts: DataFrame) -> DataFrame:
    """Adds ``reason`` (NULL: admitted).

    ``deliveries`` carry ``memory_refs``; ``acts`` are the agent_act links with their arrival. A delivery
    must name an exact context, only references that context shows, and precede every act of its run.
    """
    claims = claimed_refs(contexts, items, evidence)
    known = contexts.select(*RUN, "context_ref", F.lit(True).alias("__context"))
    first_act = acts.groupBy(*RUN).agg(F.min("arrival").alias("__act"))
    blurred = claims.groupBy(*CONTEXT).agg(F.max("ambiguous").alias("__blurred"))
    unknown = (
        deliveries.select("tenant_ref", "context_ref", "receipt_ref", F.explode("memory_refs").alias("memory_ref"))
        .join(claims.select(*CONTEXT, "memory_ref"), [*CONTEXT, "memory_ref"], "left_anti")
        .select("tenant_ref", "receipt_ref").distinct().withColumn("__unknown", F.lit(True)))
    return (
        deliveries.join(known, [*RUN, "context_ref"], "left").join(first_act, RUN, "left")
        .join(blurred, CONTEXT, "left").join(unknown, ["tenant_ref", "receipt_ref"], "left")
        .withColumn("reason", F.when(F.col("__act") < F.col("arrival"), "after_act")
                    .when(F.col("__context").isNull(), "context")
                    .when(F.col("__blurred"), "ambiguous_ref")
                    .when(F.col("__unknown"), "unknown_ref"))
        .drop("__context", "__act", "__blurred", "__unknown"))


def admit_outcomes(outcomes: DataFrame, deliveries: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``reason`` (NULL: admitted).

    Every named receipt must exist in the exact run, every related source must be linked in the group, and
    an outcome that names a receipt must relate to an act.
    """
    key = ["tenant_ref", "outcome_ref"]
    bad_receipt = (
        outcomes.select(*RUN, "outcome_ref", F.explode("receipt_refs").alias("receipt_ref"))
        .join(deliveries.select(*RUN, "receipt_ref"), [*RUN, "receipt_ref"], "left_anti")
        .select(*key).distinct().withColumn("__receipt", F.lit(True)))
    in_group = links.groupBy(*GROUP, "source_ref").agg(F.max(F.col("role") == "agent_act").alias("is_act"))
    related = (
        outcomes.select(*GROUP, "outcome_ref", F.explode("related_refs").alias("source_ref"))
        .join(in_group, [*GROUP, "source_ref"], "left")
        .groupBy(*key).agg(F.max(F.col("is_act").isNull()).alias("__unrelated"),
                           F.max(F.coalesce("is_act", F.lit(False))).alias("__acts")))
    return (
        outcomes.join(bad_receipt, key, "left").join(related, key, "left")
        .withColumn("reason", F.when(F.col("__receipt"), "unknown_receipt")
                    .when(F.col("__unrelated"), "unrelated_source")
                    .when((F.size("receipt_refs") > 0) & ~F.coalesce("__acts", F.lit(False)), "no_act"))
        .drop("__receipt", "__unrelated", "__acts"))


def delivery_job(deliveries: DataFrame, contexts: DataFrame, items: DataFrame, evidence: DataFrame,
                 acts: DataFrame) -> DataFrame:
    """Deliveries to receipts: validation, idempotency, then admission.

    A refused delivery leaves its key free: the first admitted request of a key takes it. Only accepted requests and their
    replays have a receipt.
    """
    checked = cut_lineage(validate_deliveries(deliveries))
    valid = checked.filter("reason IS NULL").drop("reason").withColumn("request_hash", refs.delivery_hash(F.col("memory_refs")))
    admitted = cut_lineage(admit_deliveries(valid, contexts, items, evidence, acts).select(*HEAD, "arrival", "request_hash", "reason"))
    at = F.struct("arrival", "request_hash")
    first = admitted.filter("reason IS NULL").groupBy(*HEAD).agg(F.min(at).alias("first"))
    status = F.when(F.col("first") < at, F.when(F.col("first.request_hash") == F.col("request_hash"), "replay").otherwise("conflict")).otherwise(F.coalesce("reason", F.lit("accepted")))
    decided = admitted.join(first, HEAD, "left").select(*HEAD, "arrival", status.alias("status"))
    refused = checked.filter("reason IS NOT NULL").select(*HEAD, "arrival", F.concat(F.lit("invalid:"), "reason").alias("status"))
    return decided.unionByName(refused).select(
        *HEAD, "arrival", "status", F.when(F.col("status").isin("accepted", "replay"), refs.delivery_ref()).otherwise("").alias("delivery_ref"))


def outcome_job(outcomes: DataFrame, deliveries: DataFrame, links: DataFrame, episodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Outcomes to receipts: validation, idempotency, admission of receipts, sources and payload, episode attachment.

    ``sources`` are the payloads observed before. A refused outcome leaves key and source free. A replay has the receipt of
    the accepted outcome, with its episode.
    """
    checked = validate_outcomes(outcomes).withColumn("source_event_ref", F.col("source_ref"))
    # texts end here: later steps see hashes and references
    checked = in_order(checked.withColumn("payload_hash", payload_hash()).withColumn("request_hash", refs.outcome_hash(
        F.array_sort("receipt_refs"), F.array_sort("related_refs"))).drop("text"))
    valid = checked.filter("reason IS NULL").drop("reason")
    admitted = cut_lineage(admit_outcomes(valid, deliveries, links).select(
        "row", "at", *GROUP, "source_ref", "source_event_ref", "idempotency_key", "arrival", "request_hash", "payload_hash",
        F.lit("outcome").alias("role"), F.col("reason").alias("refusal")))
    status = cut_lineage(admitted.join(settle(admitted, sources.withColumn("payload_hash", payload_hash())), "row"))
    receipts = status.filter("status = 'accepted'").join(episodes.select(*GROUP, "episode_ref"), GROUP, "left").select(
        *HEAD, F.coalesce("episode_ref", F.lit("")).alias("episode_ref"), refs.outcome_ref().alias("outcome_ref"))
    has = F.col("status").isin("accepted", "replay")
    decided = status.join(receipts, HEAD, "left").select(*HEAD, "arrival", "status", *[
        F.when(has, F.col(c)).otherwise("").alias(c) for c in ("episode_ref", "outcome_ref")])
    return decided.unionByName(checked.filter("reason IS NOT NULL").select(
        *HEAD, "arrival", F.concat(F.lit("invalid:"), "reason").alias("status"), F.lit("").alias("episode_ref"), F.lit("").alias("outcome_ref")))


def feedback_chain(contexts: DataFrame, items: DataFrame, delivered: DataFrame, dispositions: DataFrame,
                   links: DataFrame) -> DataFrame:
    """(episode, version, receipt): an active disposition was delivered in the run of an episode whose
    situation is the query that selected it. ``delivered`` has one row per receipt and reference."""
    ctx = contexts.select(*RUN, "context_ref")
    active = dispositions.filter("status = 'active'").select(
        "tenant_ref", F.col("version_ref").alias("memory_ref"), "root_ref", "version_number")
    shown = items.filter("item_kind = 'disposition'").select(*CONTEXT, "memory_ref", "query_source_ref")
    situations = links.filter("role = 'situation'").select(
        *RUN, "episode_ref", F.col("source_ref").alias("query_source_ref")).distinct()
    return (
        ctx.join(shown, CONTEXT).join(delivered.select(*RUN, "context_ref", "receipt_ref", "memory_ref"),
                                      [*RUN, "context_ref", "memory_ref"])
        .join(active, ["tenant_ref", "memory_ref"]).join(situations, [*RUN, "query_source_ref"])
        .select("tenant_ref", "episode_ref", F.col("memory_ref").alias("version_ref"), "root_ref",
                "version_number", "receipt_ref").distinct())


def open_feedback(chain: DataFrame, basis: DataFrame) -> DataFrame:
    """Drops episodes that already count as reenactment or inhibition of the version."""
    used = basis.filter(F.col("role").isin("reenactment", "inhibition")).select(
        "tenant_ref", "version_ref", "episode_ref")
    return chain.join(used, ["tenant_ref", "version_ref", "episode_ref"], "left_anti")


def attribute_outcomes(chain: DataFrame, outcomes: DataFrame, receipts: DataFrame) -> DataFrame:
    """(version, outcome): a non-agent outcome of the episode names one of the version's receipts.

    ``receipts`` has one row per outcome and named receipt.
    """
    named = (
        outcomes.filter("actor_kind <> 'agent' AND actor_kind <> ''").select("tenant_ref", "outcome_ref", "episode_ref")
        .join(receipts, "outcome_ref"))
    return (
        chain.join(named, ["tenant_ref", "episode_ref", "receipt_ref"])
        .select("tenant_ref", "version_ref", "outcome_ref", "episode_ref").distinct())
