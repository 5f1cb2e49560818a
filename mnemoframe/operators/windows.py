"""Consolidation windows, queue heads, sequences and window texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import refs
from ..functions.text import MAX_QUERY_BYTES, trimmed, utf8_prefix
from ..plans.split import number_rows, top_n


def assign_windows(arrivals: DataFrame, keys: Sequence[str], ts: str, tie: str, block: Column, *,
                   quiet_seconds: int = 120, max_size: int = 32, overlap: int = 4) -> DataFrame:
    """Adds ``rn`` (position in the owner), ``window_start`` (position of the window's first new episode).

    An island ends when the gap to the next arrival exceeds the quiet period. With ``earlier`` episodes
    before an island, its first window takes ``max - min(overlap, earlier)`` new episodes and every further
    one ``max - overlap``, because the rest of a window repeats its predecessor's tail. That closed form needs
    only the owner-wide position and the position of the island's first row. Both come from one pass: each
    block of an owner is summarised (size, first and last time, last island start) and the summaries carry
    the state from block to block, so a hot owner is spread over its blocks.
    """
    keys = list(keys)
    part = [*keys, "__block"]
    inside = W.partitionBy(*part).orderBy(ts, tie)
    quiet = F.lit(quiet_seconds * 1_000_000)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    cut = arrivals.withColumn("__block", block)
    local = cut.withColumn("__n", F.row_number().over(inside)).withColumn(
        "__gap", micros(F.col(ts)) - micros(F.lag(ts).over(inside)))
    local = local.withColumn("__start", F.when(F.col("__gap") > quiet, F.col("__n")))
    summary = local.groupBy(*part).agg(
        F.count(F.lit(1)).alias("size"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.max("__start").alias("last_start"))
    over = W.partitionBy(*keys).orderBy("__block")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    summary = summary.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn(
        "opens", F.lag("last_ts").over(over).isNull()
        | (micros(F.col("first_ts")) - micros(F.lag("last_ts").over(over)) > quiet))
    summary = summary.withColumn("own_start", F.coalesce(
        F.col("offset") + F.col("last_start"), F.when(F.col("opens"), F.col("offset") + 1)))
    carry = summary.select(
        *part, "offset",
        F.when(F.col("opens"), F.col("offset") + 1).otherwise(
            F.last("own_start", ignorenulls=True).over(before)).alias("carried"))
    placed = local.withColumn("__seen", F.max("__start").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    rn, first = F.col("rn"), F.col("__first")
    step = max_size - overlap
    head = F.lit(max_size) - F.least(F.lit(overlap), first - 1)
    r = rn - first
    in_head = r < head
    return (
        placed.join(carry, part)
        .withColumn("rn", F.col("__n") + F.col("offset"))
        .withColumn("__first", F.coalesce(F.col("offset") + F.col("__seen"), F.col("carried")))
        .withColumn("window_start", F.when(in_head, first).otherwise(
            first + head + F.floor((r - head) / step) * step).cast("bigint"))
        .drop("__block", "__n", "__gap", "__start", "__seen", "offset", "carried", "__first"))


def window_members(assigned: DataFrame, keys: Sequence[str], ref: str, overlap: int = 4) -> DataFrame:
    """One row per window and episode, the repeated tail of the predecessor included."""
    keys = list(keys)
    own = assigned.select(*keys, "window_start", "rn", ref, F.lit(False).alias("is_overlap"))
    heads = assigned.filter("rn = window_start AND rn > 1").select(
        *keys, "window_start",
        F.explode(F.sequence(F.greatest(F.lit(1), F.col("rn") - overlap), F.col("rn") - 1)).alias("rn"))
    tail = heads.join(assigned.select(*keys, "rn", ref), [*keys, "rn"]).withColumn("is_overlap", F.lit(True))
    return own.unionByName(tail.select(own.columns))


def frozen_windows(members: DataFrame, keys: Sequence[str], ref: str, max_size: int = 32) -> DataFrame:
    """Windows with their ordered episode references (at most ``max_size`` by construction)."""
    return members.groupBy(*keys, "window_start").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(ref).alias("ref")))), lambda s: s["ref"])
        .alias("episode_refs"))


def partition_outcomes(members: DataFrame, keys: Sequence[str], outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcome, window) for every window that holds the outcome's episode, and the outcomes outside."""
    keys = list(keys)
    placed = members.select(*keys, "episode_ref", "window_start", "is_overlap").join(outcomes, [*keys, "episode_ref"])
    outside = outcomes.join(members.select(*keys, "episode_ref"), [*keys, "episode_ref"], "left_anti")
    return placed, outside


def head_of(rows: DataFrame, keys: Sequence[str], order: str, open_rows: Column) -> DataFrame:
    """Earliest open row per key (argmin, combined before the shuffle)."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.filter(open_rows).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("h"))
    return picked.select(*keys, *[F.col("h")[c].alias(c) for c in rest])


def next_sequence(new_ops: DataFrame, existing: DataFrame, block: Column) -> DataFrame:
    """Sequence numbers for unseen operations of each stream, continuing its current maximum."""
    unseen = new_ops.join(existing.select("operation_id"), "operation_id", "left_anti")
    once = unseen.groupBy("stream_ref", "operation_id").agg(F.min("arrival").alias("arrival"))
    top = existing.groupBy("stream_ref").agg(F.max("stream_sequence").alias("__top"))
    return (
        number_rows(once, ["stream_ref"], ["arrival", "operation_id"], block)
        .join(top, "stream_ref", "left")
        .withColumn("stream_sequence", F.coalesce("__top", F.lit(0)) + F.col("rn")).drop("rn", "__top"))


def query_text(situations: DataFrame, keys: Sequence[str], order: Sequence[str],
               max_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """Concatenated situation texts per window, cut at a whole character within ``max_bytes``.

    Every text takes at least two bytes, so only the first ``max_bytes / 2`` of a window can matter and the
    group limit keeps a window small before it is gathered. A running byte count then drops texts behind the
    cut, up to the four that may still use bytes freed by a split character.
    """
    keys = list(keys)
    said = situations.withColumn("__t", trimmed("text")).filter("__t <> ''")
    few = top_n(said.select(*keys, *order, "__t"), keys, list(order), max_bytes // 2 + 1, "__i")
    over = W.partitionBy(*keys).orderBy("__i")
    start = F.sum(F.octet_length("__t") + 1).over(over.rowsBetween(W.unboundedPreceding, -1))
    near = few.withColumn("__at", F.coalesce(start, F.lit(0)))
    near = near.withColumn("__four", F.coalesce(F.lag("__at", 4).over(over), F.lit(0))).filter(
        F.col("__four") < max_bytes)
    texts = near.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("__i", utf8_prefix("__t", max_bytes).alias("t")))),
        lambda s: s["t"]).alias("texts"))

    def add(acc: Column, t: Column) -> Column:
        used = F.octet_length(acc)
        gap = F.when(used > 0, F.lit("\n")).otherwise(F.lit(""))
        return F.when(used >= max_bytes, acc).otherwise(
            F.concat(acc, gap, utf8_prefix(t, F.lit(max_bytes) - used - F.octet_length(gap))))

    return texts.select(*keys, F.aggregate("texts", F.lit(""), add).alias("query_text"))


def consolidation_receipt(versions: DataFrame) -> DataFrame:
    """Sorted version references that a job created (a job's output is bounded by its text limit)."""
    return versions.groupBy("tenant_ref", "origin_job_ref").agg(
        F.sort_array(F.collect_set("version_ref")).alias("version_refs"))


def state_hash(targets: DataFrame, basis: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash of a window's offered memories and their basis; equal hashes mean an unchanged snapshot.

    A memory is one row and each link of its basis another; they pass the digest in order and are never gathered.
    """
    fields = F.array(*refs.OWNER_FIELDS, "root_ref", "version_ref", F.col("version_number").cast("string"), "text", "application_scope")
    heads = targets.select(*keys, "version_ref", F.lit("").alias("link"), fields.alias("fields"))
    state = basis.select("tenant_ref", "version_ref", F.concat("role", F.lit("\0"), "episode_ref").alias("link")).distinct()
    links = targets.select(*dict.fromkeys([*keys, "tenant_ref"]), "version_ref").join(state, ["tenant_ref", "version_ref"]).select(*keys, "version_ref", "link", F.array("link").alias("fields"))
    return refs.ordered_digest(heads.unionByName(links), keys, ["version_ref", "link"], "fields", "recollection-state.v1", "state_hash")


def feedback_state_hash(targets: DataFrame, offers: DataFrame, basis: DataFrame, receipts: DataFrame, key: str = "window_ref") -> DataFrame:
    """Hash of the dispositions that a window may change and of all that speaks for each; equal hashes mean an unchanged snapshot.

    ``targets``: key, owner columns, root_ref, version_ref, version_number, text. ``offers``: key, version_ref, ref, what (episode, direct, outcome,
    anchor), episode_ref (of an outcome). ``basis``: version_ref, episode_ref, role. ``receipts``: key, version_ref, episode_ref, receipt_ref of
    episodes that still count.
    """
    own = [key, "version_ref"]
    none = F.lit("")

    def part(df: DataFrame, place: int, one: Column | str, two: Column | str, fields: Column) -> DataFrame:
        column = lambda c: F.col(c) if isinstance(c, str) else c
        return df.select(*own, F.lit(place).alias("part"), column(one).alias("one"), column(two).alias("two"), fields.alias("fields")).distinct()

    head = F.array(*refs.OWNER_FIELDS, "root_ref", "version_ref", F.col("version_number").cast("string"), "text")
    what = lambda name: offers.filter(F.col("what") == name).join(targets.select(*own), own, "left_semi")
    state = F.concat(F.lit("episode\0"), "role", F.lit("\0"), "episode_ref")
    held = targets.select(*own).join(basis.select("version_ref", "episode_ref", "role"), "version_ref")
    rows = part(targets, 0, none, none, head)
    for place, name in ((2, "direct-episodes"), (4, "outcomes"), (6, "anchors"), (8, "basis-state")):
        rows = rows.unionByName(part(targets, place, none, none, F.array(F.lit(name))))
    rows = rows.unionByName(part(what("episode"), 1, "ref", none, F.array("ref"))).unionByName(part(what("direct"), 3, "ref", none, F.array("ref")))
    rows = rows.unionByName(part(what("outcome"), 5, "ref", none, F.array("ref", "episode_ref"))).unionByName(part(what("anchor"), 7, "ref", none, F.array("ref")))
    rows = rows.unionByName(part(held, 9, state, none, F.array(state)))
    got = receipts.join(targets.select(*own), own, "left_semi")
    rows = rows.unionByName(part(got, 10, "episode_ref", none, F.array(F.lit("receipts"), F.col("episode_ref")))).unionByName(
        part(got, 10, "episode_ref", "receipt_ref", F.array("receipt_ref")))
    return refs.ordered_digest(rows, [key], ["version_ref", "part", "one", "two"], "fields", "feedback-state.v1", "state_hash")


def stale_guard(computed: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``stale``: the state hash a window was computed on no longer holds."""
    now = current.select(*keys, F.col("state_hash").alias("current_hash"))
    return computed.join(now, list(keys), "left").withColumn(
        "stale", ~F.col("state_hash").eqNullSafe(F.col("current_hash")))


def merge_refs(existing: str | Column, added: str | Column) -> Column:
    """Append unseen, non-empty references and keep the order."""
    e = F.col(existing) if isinstance(existing, str) else existing
    a = F.col(added) if isinstance(added, str) else added
    return F.concat(e, F.array_except(F.filter(a, lambda r: r != ""), e))
