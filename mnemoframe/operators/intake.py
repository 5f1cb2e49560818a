"""Validation, idempotent admission and episode formation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import refs
from ..functions.text import MAX_EVIDENCE_BYTES, MAX_REF_BYTES, MAX_TEXT_BYTES, has_space
from ..plans.session import cut_lineage
from ..plans.split import top_n

SCOPE = list(refs.SCOPE)
GROUP = [*SCOPE, "run_ref", "source_group_ref"]
SOURCE_KEY = [*SCOPE, "source_ref"]
ACTOR_KINDS = ("agent", "user", "system", "tool", "external")
ROLES = ("situation", "agent_act", "outcome")


def stable(c: str | Column) -> Column:
    """A required reference: non-empty, within the byte limit."""
    c = F.col(c) if isinstance(c, str) else c
    return (c != "") & (F.octet_length(c) <= MAX_REF_BYTES)


def stable_tight(c: str | Column) -> Column:
    """A required reference without white space."""
    return stable(c) & ~has_space(c)


def _optional(c: str) -> Column:
    return F.octet_length(F.col(c)) <= MAX_REF_BYTES


def _first_failure(*checks: tuple[Column, str]) -> Column:
    """Reason of the first check that fails, NULL when all pass."""
    reason = F.when(~checks[0][0], checks[0][1])
    for ok, name in checks[1:]:
        reason = reason.when(~ok, name)
    return reason


def _scope_kind_ok() -> Column:
    return F.when(F.col("scope_kind") == "agent", F.col("relationship_ref") == "").when(
        F.col("scope_kind") == "relationship", F.col("relationship_ref") != "").otherwise(False)


def _nul(c: str) -> Column:
    return F.instr(F.col(c), "\0") > 0


def source_reason() -> Column:
    """Why a source event is refused (NULL: valid). Checks run in a fixed order; the first failure wins."""
    both = (F.col("constitution_ref") == "") == (F.col("constitution_text") == "")
    constitution = both & ((F.col("constitution_ref") == "") | stable_tight("constitution_ref")) & (
        F.octet_length("constitution_text") <= MAX_TEXT_BYTES)
    return _first_failure(
        (~(_nul("constitution_ref") | _nul("constitution_text")), "constitution_nul"),
        (constitution, "constitution"),
        (stable("source_ref"), "source_ref"),
        (stable("tenant_ref") & stable("agent_ref") & _optional("relationship_ref") & _optional("session_ref"),
         "scope_refs"),
        (_scope_kind_ok(), "scope_kind"),
        (F.col("actor_kind").isin(*ACTOR_KINDS) & stable("actor_ref"), "actor"),
        (F.col("text") != "", "text_empty"),
        (F.octet_length("text") <= MAX_TEXT_BYTES, "text_too_long"),
    )


def binding_state() -> Column:
    """``none`` (admit without a link), ``ok``, or the reason of refusal."""
    incomplete = (F.col("run_ref") == "") | (F.col("source_group_ref") == "")
    short = _optional("run_ref") & _optional("source_group_ref")
    own_act = (F.col("actor_kind") == "agent") & (F.col("actor_ref") == F.col("agent_ref"))
    return (
        F.when(~short, "binding_refs").when(incomplete, "none")
        .when(~F.col("role").isin(*ROLES), "role")
        .when((F.col("role") == "agent_act") & ~own_act, "agent_act_actor").otherwise("ok")
    )


def validate_sources(df: DataFrame) -> DataFrame:
    return df.withColumn("reason", source_reason())


def validate_bindings(df: DataFrame) -> DataFrame:
    return df.withColumn("binding", binding_state())


def _unique_tight(array: str) -> Column:
    a = F.col(array)
    return (F.size(F.array_distinct(a)) == F.size(a)) & F.forall(a, stable_tight)


def validate_deliveries(df: DataFrame) -> DataFrame:
    """Adds ``reason``; ``memory_refs`` is the array of delivered references."""
    return df.withColumn("reason", _first_failure(
        (stable("idempotency_key"), "idempotency_key"),
        (stable_tight("run_ref"), "run_ref"),
        (stable_tight("context_ref"), "context_ref"),
        (F.size("memory_refs") > 0, "no_refs"),
        (_unique_tight("memory_refs"), "refs"),
        (stable("tenant_ref") & stable("agent_ref") & _optional("relationship_ref") & _optional("session_ref")
         & _scope_kind_ok(), "scope"),
    ))


def validate_outcomes(df: DataFrame) -> DataFrame:
    """Adds ``reason``; arrays ``receipt_refs`` and ``related_refs``, the source as ``source_ref``."""
    with_role = df.withColumn("role", F.lit("outcome"))
    head = _first_failure(
        (stable("idempotency_key"), "idempotency_key"),
        (stable_tight("run_ref"), "run_ref"),
        (stable_tight("source_group_ref"), "source_group_ref"),
        (_unique_tight("receipt_refs"), "receipt_refs"),
        (_unique_tight("related_refs"), "related_refs"),
    )
    binding = F.when(~binding_state().isin("ok", "none"), binding_state())
    return with_role.withColumn("reason", F.coalesce(head, source_reason(), binding)).drop("role")


def validate_selects(df: DataFrame) -> DataFrame:
    """Adds ``reason``; ``situation_refs`` is the array of current situation sources."""
    ref, text = F.col("constitution_ref"), F.col("constitution_text")
    return df.withColumn("reason", _first_failure(
        (stable_tight("run_ref"), "run_ref"),
        ((F.size("situation_refs") > 0) & _unique_tight("situation_refs"), "situation_refs"),
        (F.col("evidence_bytes").between(0, MAX_EVIDENCE_BYTES), "evidence_bytes"),
        ((F.col("tenant_ref") != "") & (F.col("agent_ref") != ""), "scope_refs"),
        (_scope_kind_ok(), "scope_kind"),
        (((ref == "") == (text == "")) & ((ref == "") | stable_tight("constitution_ref")), "constitution"),
    ))


def first_accept(df: DataFrame, keys: list[str], hash_col: str, order: str = "arrival") -> DataFrame:
    """Adds ``status``: the first request of a key is ``new``, an equal one ``replay``, another ``conflict``.

    Argmin per key is combined map-side, so a key with very many requests shuffles one row per task; the
    join back is a plain equi-join that AQE may split. Of requests with equal ``order`` the smallest hash is the first.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("o"), F.col(hash_col).alias("h"))).alias("first")).select(
        *keys, F.col("first.o").alias("first_arrival"), F.col("first.h").alias("first_hash"))
    return df.join(first, keys).withColumn(
        "status",
        F.when((F.col(order) == F.col("first_arrival")) & (F.col(hash_col) == F.col("first_hash")), "new")
        .when(F.col(hash_col) == F.col("first_hash"), "replay").otherwise("conflict"),
    ).drop("first_hash")


def payload_hash() -> Column:
    """What must not change when a source is observed again."""
    return F.sha2(F.concat_ws("", *[refs.encoded(c) for c in (
        "actor_kind", "actor_ref", "text", "constitution_ref", "constitution_text")]), 256)


def first_source(df: DataFrame) -> DataFrame:
    """Adds ``source_status``: the first payload of a source key is canonical, differing later ones conflict."""
    marked = df.withColumn("__payload", F.col("payload_hash") if "payload_hash" in df.columns else payload_hash())
    first = marked.groupBy(*SOURCE_KEY).agg(F.min(F.struct("arrival", "__payload")).alias("first")).select(
        *SOURCE_KEY, F.col("first.arrival").alias("source_arrival"), F.col("first.__payload").alias("__first"))
    return marked.join(first, SOURCE_KEY).withColumn(
        "source_status",
        F.when((F.col("arrival") == F.col("source_arrival")) & (F.col("__payload") == F.col("__first")), "new")
        .when(F.col("__payload") == F.col("__first"), "same").otherwise("conflict"),
    ).drop("__payload", "__first")


def gates(links: DataFrame) -> DataFrame:
    """Per group the arrival at which its episode materialises (groups without an episode are absent).

    The gate opens when a situation, an act and two different sources among them are present, so it is the
    latest of: first situation, first act, first arrival of the second distinct source.
    """
    core = links.filter(F.col("role").isin("situation", "agent_act"))
    sources = core.groupBy(*GROUP, "source_ref").agg(
        F.min(F.when(F.col("role") == "situation", F.col("arrival"))).alias("s"),
        F.min(F.when(F.col("role") == "agent_act", F.col("arrival"))).alias("a"),
        F.min("arrival").alias("seen"))
    second = (
        top_n(sources.select(*GROUP, "source_ref", "seen"), GROUP, ["seen", "source_ref"], 2, "n")
        .filter("n = 2").select(*GROUP, "seen"))
    firsts = sources.groupBy(*GROUP).agg(F.min("s").alias("s"), F.min("a").alias("a"))
    return (
        firsts.filter("s IS NOT NULL AND a IS NOT NULL").join(second, GROUP)
        .select(*GROUP, F.greatest("s", "a", "seen").alias("gate")))


def sealing(links: DataFrame) -> DataFrame:
    """Adds ``accepted``: after the gate only outcomes and repetitions of existing links get in."""
    first = links.groupBy(*GROUP, "source_ref", "role").agg(F.min("arrival").alias("__first"))
    return (
        links.join(gates(links), GROUP, "left").join(first, [*GROUP, "source_ref", "role"])
        .withColumn("accepted", F.col("gate").isNull() | (F.col("arrival") <= F.col("gate"))
                    | (F.col("role") == "outcome") | (F.col("__first") <= F.col("gate")))
        .drop("__first"))


def materialize_episodes(links: DataFrame) -> DataFrame:
    """One row per group whose situation and act come from different sources.

    "A situation differs from an act" is the same as: both sets are non-empty and their union holds two
    sources, which min/max over one aggregation decide without a self-join.
    """
    core = F.when(F.col("role").isin("situation", "agent_act"), F.col("source_ref"))
    return (
        links.groupBy(*GROUP).agg(
            F.max((F.col("role") == "situation")).alias("has_situation"),
            F.max((F.col("role") == "agent_act")).alias("has_act"),
            F.min(core).alias("lo"), F.max(core).alias("hi"))
        .filter("has_situation AND has_act AND lo <> hi")
        .select(*GROUP, refs.episode_ref().alias("episode_ref")))


def backfill_outcomes(outcomes: DataFrame, episodes: DataFrame) -> DataFrame:
    """Outcomes recorded before their episode take its reference once it exists."""
    known = episodes.select(*GROUP, F.col("episode_ref").alias("__episode"))
    return (
        outcomes.join(known, GROUP, "left")
        .withColumn("episode_ref", F.coalesce(F.when(F.col("episode_ref") != "", F.col("episode_ref")),
                                              F.col("__episode"), F.lit("")))
        .drop("__episode"))


HEAD = ["tenant_ref", "idempotency_key"]


def _with(rows: DataFrame, some: DataFrame, on: list[str]) -> DataFrame:
    """Rows that share a key with some others."""
    return rows.join(some.select(*on).distinct(), on, "left_semi")


def _settled(todo: DataFrame, taken: DataFrame, known: DataFrame | None) -> DataFrame:
    """(row, status) of each row of ``todo`` if exactly the rows of ``taken`` were accepted.

    A row looks only at what came before it: the first accepted request of its key, the first accepted payload of its source
    (``known`` ones came before all), its own ``refusal`` if any, and the moment its group was sealed.
    """
    key = taken.groupBy(*HEAD).agg(F.min("at").alias("__key"), F.min_by("request_hash", "at").alias("__hash"))
    payload = taken.groupBy(*SOURCE_KEY).agg(F.min("at").alias("__seen"), F.min_by("payload_hash", "at").alias("__payload"))
    links = taken.filter("run_ref <> '' AND source_group_ref <> '' AND role <> ''")
    repeated = links.groupBy(*GROUP, "source_ref", "role").agg(F.min("arrival").alias("__link"))
    joined = (
        todo.join(key, HEAD, "left").join(payload, SOURCE_KEY, "left").join(gates(links), GROUP, "left")
        .join(repeated, [*GROUP, "source_ref", "role"], "left"))
    clash = (F.col("__seen") < F.col("at")) & (F.col("__payload") != F.col("payload_hash"))
    if known is not None:
        joined = joined.join(known.select(*SOURCE_KEY, F.col("payload_hash").alias("__known")), SOURCE_KEY, "left")
        clash = F.coalesce(clash, F.lit(False)) | (F.col("__known") != F.col("payload_hash"))
    sealed = (F.col("gate") < F.col("arrival")) & (F.col("role") != "outcome") & ~F.coalesce(F.col("__link") <= F.col("gate"), F.lit(False))
    return joined.select("row", F.when(F.col("__key") < F.col("at"), F.when(F.col("__hash") == F.col("request_hash"), "replay").otherwise("conflict"))
                         .when(F.col("refusal").isNotNull(), F.col("refusal")).when(clash, "source_conflict").when(sealed, "sealed").otherwise("accepted").alias("status"))


def settle(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(row, status) of requests in arrival order, when a refused request leaves nothing behind: neither key nor source nor link.

    ``rows``: row (unique), at (struct that orders all rows), arrival, tenant and key, request_hash, payload_hash, source,
    group and role, refusal (NULL, or why the request is refused once its key is free). Decisions start from a guess of what is
    accepted and are made again for the rows that share a key, a source or a group with a row whose acceptance changed.
    Since a row depends on earlier ones only, the rounds end with the one outcome that a walk in arrival order has.
    """
    first = rows.groupBy(*HEAD).agg(F.min("at").alias("at"))
    taken = cut_lineage(rows.filter("refusal IS NULL").join(first, [*HEAD, "at"], "left_semi"))
    todo, decided = rows, None
    while True:
        # what decides a row has its key, its source or its group
        near = taken if decided is None else _with(taken, todo, HEAD).unionByName(_with(taken, todo, SOURCE_KEY)).unionByName(_with(taken, todo, GROUP)).dropDuplicates(["row"])
        now = cut_lineage(_settled(todo, near, known))
        decided = now if decided is None else cut_lineage(decided.join(now.select("row"), "row", "left_anti").unionByName(now))
        # only what was decided in this round can move
        was = taken.select("row", F.lit(True).alias("__was"))
        moved = cut_lineage(todo.join(now.select("row", (F.col("status") == "accepted").alias("__is")), "row").join(was, "row", "left").filter(
            F.col("__is") != F.coalesce("__was", F.lit(False))).drop("__was"))
        if moved.isEmpty():
            return decided
        taken = cut_lineage(taken.join(moved.select("row"), "row", "left_anti").unionByName(moved.filter("__is").drop("__is")))
        todo = cut_lineage(_with(rows, moved, HEAD).unionByName(_with(rows, moved, SOURCE_KEY)).unionByName(_with(rows, moved, GROUP)).dropDuplicates(["row"]))


def in_order(rows: DataFrame) -> DataFrame:
    """Adds ``row`` and ``at``: arrival, then the request itself, then the row number of the written table."""
    numbered = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    return numbered.withColumn("at", F.struct("arrival", "request_hash", "row"))


def hashed_requests(requests: DataFrame) -> DataFrame:
    """Requests without their texts: keys, order, hashes, and the reason why a request is malformed."""
    return in_order(requests.withColumn("reason", F.coalesce(
        source_reason(), F.when(~binding_state().isin("ok", "none"), binding_state()))).select(
        *GROUP, "source_ref", "role", "idempotency_key", "arrival", "reason",
        refs.observe_hash().alias("request_hash"), payload_hash().alias("payload_hash")))


def well_formed(checked: DataFrame) -> DataFrame:
    return checked.filter("reason IS NULL").withColumn("refusal", F.lit(None).cast("string")).drop("reason")


def request_receipts(status: DataFrame, checked: DataFrame) -> DataFrame:
    """``status`` of every request and, once the gate is open, the episode reference."""
    links = status.filter("status = 'accepted' AND run_ref <> '' AND source_group_ref <> ''")
    given = links.join(gates(links), GROUP).filter("arrival >= gate").select("row", refs.episode_ref().alias("episode_ref"))
    receipts = status.filter("status = 'accepted'").join(given, "row", "left").select(*HEAD, F.coalesce("episode_ref", F.lit("")).alias("episode_ref"))
    decided = status.join(receipts, HEAD, "left").select(
        "row", *HEAD, "arrival", "status", F.when(F.col("status").isin("accepted", "replay"), F.col("episode_ref")).otherwise("").alias("episode_ref"))
    refused = checked.filter("reason IS NOT NULL").select(
        "row", *HEAD, "arrival", F.concat(F.lit("invalid:"), "reason").alias("status"), F.lit("").alias("episode_ref"))
    return decided.unionByName(refused)


def intake_job(requests: DataFrame) -> DataFrame:
    """Requests to receipts: ``status`` and, once the gate is open, the episode reference.

    A request that is refused, because its source has another payload or its group is sealed, frees its key and its source. A
    replay gets the receipt of the accepted request. Texts are read once; later steps see hashes and references only.
    """
    checked = hashed_requests(requests)
    valid = well_formed(checked)
    return request_receipts(valid.join(settle(valid), "row"), checked).drop("row")
