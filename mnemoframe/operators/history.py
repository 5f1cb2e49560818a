"""Conversation histories: pairs, sessions, cuts and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.split import number_rows, ranges_of, running_max, running_sum


def _texts(role_rows: Column) -> Column:
    """Texts of the flagged rows in turn order, joined by a blank line."""
    rows = F.filter(F.collect_list(F.when(role_rows, F.struct("turn", "text"))), lambda s: s.isNotNull())
    return F.array_join(F.transform(F.array_sort(rows), lambda s: s["text"]), "\n\n")


def dialogue(messages: DataFrame, key: str = "conv_id", block_turns: int = 4096) -> dict[str, DataFrame]:
    """Histories to ``pairs``, ``background``, ``trailing`` and ``violations``.

    A null assistant message removes the user messages it leaves unanswered; blank messages vanish; runs of
    one role merge. Number the assistant messages (null ones included): the user messages in front of one form
    a segment. A segment closed by a null message disappears; a segment with user text opens a pair, and later
    segments without user text continue its answer. So two running counts replace a walk over the messages.
    """
    first = messages.filter("role <> 'system'").groupBy(key).agg(F.min("turn").alias("__first"))
    placed = messages.join(first, key, "left")
    lead_system = F.col("__first").isNull() | (F.col("turn") < F.col("__first"))
    background = placed.filter((F.col("role") == "system") & lead_system).groupBy(key).agg(
        _texts(F.lit(True)).alias("background"))
    stray = placed.filter(~lead_system & ~F.col("role").isin("user", "assistant")).select(
        key, "turn", F.lit("unexpected_role").alias("reason"))
    said = F.trim("text") != ""
    kept = placed.filter(F.col("role").isin("user", "assistant") & (said | (F.col("text").isNull() & (F.col("role") == "assistant"))))
    kept = kept.select(key, "turn", "role", "text", F.when(F.col("role") == "assistant", 1).otherwise(0).alias("__a"))
    block = ranges_of("turn", block_turns)
    counted = running_sum(kept, [key], ["turn"], block, "__a", "__count").withColumn(
        "segment", F.col("__count") - F.col("__a"))
    segments = counted.groupBy(key, "segment").agg(
        F.min("turn").alias("turn"),
        _texts(F.col("role") == "user").alias("user_text"),
        _texts((F.col("role") == "assistant") & F.col("text").isNotNull()).alias("agent_text"),
        F.max((F.col("role") == "assistant") & F.col("text").isNull()).alias("voided"),
        F.max(F.col("role") == "assistant").alias("answered"))
    live = segments.filter("NOT voided").withColumn("__opens", F.when(F.col("user_text") != "", 1).otherwise(0))
    pairs_no = running_sum(live, [key], ["segment"], ranges_of("segment", block_turns), "__opens", "__pair")
    merged = pairs_no.groupBy(key, F.col("__pair").alias("pair_idx")).agg(
        F.min("turn").alias("turn"),
        F.max("user_text").alias("user_text"),
        F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.when(
            F.col("agent_text") != "", F.struct("segment", "agent_text"))), lambda s: s.isNotNull())),
            lambda s: s["agent_text"]), "\n\n").alias("agent_text"))
    pairs = merged.filter("pair_idx > 0 AND agent_text <> ''").withColumn("pair_idx", F.col("pair_idx") - 1)
    trailing = merged.filter("pair_idx > 0 AND agent_text = ''").select(key, F.col("user_text").alias("trailing"))
    orphan = merged.filter("pair_idx = 0").select(key, "turn", F.lit("assistant_first").alias("reason"))
    return {"pairs": pairs, "background": background, "trailing": trailing, "violations": stray.unionByName(orphan)}


def check_alternation(messages: DataFrame, key: str = "conv_id", block_turns: int = 4096) -> DataFrame:
    """Violations: turns not contiguous, role against the parity of its place, odd number of messages."""
    spoken = messages.filter("role <> 'system'").select(key, "turn", "role")
    placed = number_rows(spoken, [key], ["turn"], ranges_of("turn", block_turns))
    ends = spoken.groupBy(key).agg(F.min("turn").alias("__first"), F.count(F.lit(1)).alias("__n"), F.max("turn").alias("__last"))
    both = placed.join(ends, key)
    expected = F.when(F.col("rn") % 2 == 1, "user").otherwise("assistant")
    reason = F.when(F.col("turn") != F.col("__first") + F.col("rn") - 1, "gap").when(F.col("role") != expected, "role")
    rows = both.withColumn("reason", reason).filter("reason IS NOT NULL").select(key, "turn", "reason")
    odd = ends.filter("__n % 2 = 1").select(key, F.col("__last").alias("turn"), F.lit("odd").alias("reason"))
    return rows.unionByName(odd)


def fixed_batches(pairs: DataFrame, keys: Sequence[str], order: str, block: Column, n: int = 28) -> DataFrame:
    """Adds ``batch``: place within the key divided by the batch size."""
    return number_rows(pairs, keys, [order], block).withColumn(
        "batch", F.floor((F.col("rn") - 1) / n).cast("bigint"))


def session_episodes(messages: DataFrame, key: str = "conv_id", block_turns: int = 4096) -> DataFrame:
    """Role rows of each session: the next user message is the outcome of a pair and the next situation.

    A message's place alone says which role rows it gives, so no neighbour has to be looked up; the session
    length drops the situation of a last unanswered message.
    """
    spoken = messages.filter("role <> 'system'")
    placed = number_rows(spoken, [key], ["turn"], ranges_of("turn", block_turns)).withColumn("p", F.col("rn") - 1)
    size = spoken.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    row = lambda episode, role: F.struct(episode.cast("bigint").alias("episode"), F.lit(role).alias("role"))
    half = F.floor(F.col("p") / 2)
    even = F.col("p") % 2 == 0
    roles = F.array_compact(F.array(
        F.when(even & (F.col("p") + 1 < F.col("__n")), row(half, "situation")),
        F.when(even & (F.col("p") >= 2), row(half - 1, "outcome")),
        F.when(~even, row(half, "agent_act"))))
    return placed.join(size, key).select(key, "source_ref", F.explode(roles).alias("r")).select(
        key, "source_ref", "r.episode", "r.role")


def replay_lookup(requests: DataFrame, completed: DataFrame) -> DataFrame:
    """Each distinct request input with ``answered``, ``missing`` or ``conflict`` and its output."""
    done = completed.filter("input <> '' AND output <> ''").groupBy(F.sha2("input", 256).alias("input_hash")).agg(
        F.min("output").alias("output"), (F.min("output") != F.max("output")).alias("__conflict"))
    asked = requests.groupBy(F.sha2("input", 256).alias("input_hash")).agg(F.count(F.lit(1)).alias("requests"))
    status = F.when(F.col("__conflict"), "conflict").when(F.col("output").isNull(), "missing").otherwise("answered")
    return asked.join(done, "input_hash", "left").select(
        "input_hash", "requests", status.alias("status"),
        F.when(~F.coalesce("__conflict", F.lit(False)), F.col("output")).alias("output"))


def visible_history(probes: DataFrame, timeline: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Last timeline place each probe may see: the longest prefix of sessions dated up to the probe.

    The running maximum of dates never falls along the timeline, so the prefix is an as-of lookup. Probes and
    sessions are put on one line and a running maximum of the place does it without pairing any two rows.
    ``block`` cuts the line by date (column ``at``).
    """
    keys = list(keys)
    high = running_max(timeline, keys, ["place"], ranges_of("place"), "date", "__high")
    line = high.select(*keys, F.col("__high").alias("at"), F.lit(0).alias("kind"), "place", F.lit("").alias("probe_ref"))
    asks = probes.select(*keys, F.col("date").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("place"), "probe_ref")
    merged = running_max(line.unionByName(asks), keys, ["at", "kind", "probe_ref", "place"], block, "place", "visible_until")
    return merged.filter("kind = 1").select(*keys, "probe_ref", "visible_until")


def _as_of(probes: DataFrame, line: DataFrame, keys: Sequence[str], before: Column, at: Column, width: int) -> DataFrame:
    """For every probe the largest place on the line whose ``at`` is below the probe's ``before``."""
    marks = line.select(*keys, at.alias("__at"), F.lit(1).alias("__kind"), F.col("at").alias("__place"), F.lit("").alias("probe_ref"))
    # of equal numbers the probe stands first, so that the line's are not below it
    asks = probes.select(*keys, before.alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("bigint").alias("__place"), "probe_ref")
    seen = running_max(marks.unionByName(asks), keys, ["__at", "__kind", "probe_ref", "__place"], ranges_of("__at", width), "__place", "visible_until")
    return seen.filter("__kind = 0").select("probe_ref", "visible_until")


def history_cuts(probes: DataFrame, line: DataFrame, keys: Sequence[str], width: int = 65536) -> DataFrame:
    """(probe_ref, cut, visible_until): the last place of its bank that a probe may see, by three cuts; NULL if there is none.

    ``line``: keys, at (place, whole numbers along the bank), turn, date. ``probes``: the same and probe_ref, each at a place of the line. Cut ``turn``: all before the
    probe's own turn; ``session``: all before its session; ``date``: the longest prefix of the bank dated up to the probe. Each cut is a merge
    of probes and line by place or by the running maximum of dates, in blocks of that order, so a bank of any size spreads over many tasks.
    """
    keys = list(keys)
    cut = lambda df, name: df.select("probe_ref", F.lit(name).alias("cut"), "visible_until")
    turn = _as_of(probes, line, keys, F.col("at"), F.col("at"), width)
    session = _as_of(probes, line, keys, F.col("at") - F.col("turn"), F.col("at"), width)
    high = running_max(line, keys, ["at"], ranges_of("at", width), "date", "__high")
    date = _as_of(probes, high, keys, F.col("date") + 1, F.col("__high"), width)
    return cut(turn, "turn").unionByName(cut(session, "session")).unionByName(cut(date, "date"))


def evidence_violations(evidence: DataFrame, targets: DataFrame, messages: DataFrame) -> DataFrame:
    """Cited evidence must exist, be unique and precede its target; the target text must be unchanged."""
    known = messages.select("conv_id", F.col("turn").alias("evidence_turn"), F.lit(True).alias("__known"))
    cited = evidence.groupBy("probe_ref", "conv_id", "evidence_turn").agg(F.count(F.lit(1)).alias("__times"))
    rows = (
        cited.join(known, ["conv_id", "evidence_turn"], "left")
        .join(targets.select("probe_ref", "target_turn"), "probe_ref")
        .withColumn("reason", F.when(F.col("__known").isNull(), "missing").when(F.col("__times") > 1, "duplicate")
                    .when(F.col("evidence_turn") >= F.col("target_turn"), "not_before"))
        .filter("reason IS NOT NULL").select("probe_ref", "evidence_turn", "reason"))
    text = messages.select("conv_id", F.col("turn").alias("target_turn"), F.sha2("text", 256).alias("__hash"))
    changed = targets.join(text, ["conv_id", "target_turn"], "left").filter(
        ~F.col("__hash").eqNullSafe(F.col("target_hash"))).select(
        "probe_ref", F.col("target_turn").alias("evidence_turn"), F.lit("target_changed").alias("reason"))
    return rows.unionByName(changed)


def export_state(versions: DataFrame, basis: DataFrame, episodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Flat export of an owner's memory: all versions, their basis with sessions, their jobs."""
    owner = ["tenant_ref", "scope_kind", "agent_ref", "relationship_ref"]
    v = versions.select(*owner, F.lit("version").alias("section"), "version_ref", F.col("status").alias("detail"),
                        F.sha2("text", 256).alias("item"), F.lit("").alias("session_ref"))
    b = (
        basis.join(versions.select("tenant_ref", "version_ref", *owner[1:]), ["tenant_ref", "version_ref"])
        .join(episodes.select("tenant_ref", "episode_ref", "session_ref"), ["tenant_ref", "episode_ref"])
        .select(*owner, F.lit("basis").alias("section"), "version_ref", F.col("role").alias("detail"),
                F.col("episode_ref").alias("item"), "session_ref"))
    j = jobs.select(*owner, F.lit("job").alias("section"), F.lit("").alias("version_ref"), F.lit("").alias("detail"),
                    F.col("origin_job_ref").alias("item"), F.lit("").alias("session_ref")).distinct()
    return v.unionByName(b).unionByName(j)
