"""Window evidence, formation rules and formation materials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import MAX_WINDOW_BYTES, quoted_lines, render_constitution, render_window_episode, trimmed
from ..plans.session import cut_lineage
from ..plans.split import top_n
from .intake import GROUP, SCOPE

ORIGINS = ("current", "related", "revision_anchor")


def episode_sources(episodes: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Flat (episode, role, source) rows with actor, text and admission data."""
    e = episodes.select(*GROUP, "episode_ref")
    l = links.select(*GROUP, "episode_ref", "source_ref", "role")
    s = sources.select(*SCOPE, "source_ref", "actor_kind", "actor_ref", "text", "constitution_ref", "constitution_text", "admission_order")
    return e.join(l, [*GROUP, "episode_ref"]).join(s, [*SCOPE, "source_ref"])


def episode_flags(rows: DataFrame) -> DataFrame:
    """What an episode may be used for.

    ``formation_roles``: a situation and an act of the owner's agent from different sources.
    ``other_situation``/``user_situation``: a situation not written by the agent / written by a user.
    ``repeats``: one source has two roles, which makes the episode unusable as formation basis.
    """
    own_act = (F.col("role") == "agent_act") & (F.col("actor_kind") == "agent") & (F.col("actor_ref") == F.col("agent_ref"))
    situation = F.col("role") == "situation"
    core = F.when(situation | own_act, F.col("source_ref"))
    per_source = rows.groupBy(*SCOPE, "episode_ref", "source_ref").agg(
        F.count(F.lit(1)).alias("roles"), F.max(situation).alias("s"), F.max(own_act).alias("a"), F.min(core).alias("core"),
        F.max(situation & ~F.col("actor_kind").isin("agent", "")).alias("other"),
        F.max(situation & (F.col("actor_kind") == "user")).alias("user"))
    return per_source.groupBy(*SCOPE, "episode_ref").agg(
        (F.max("s") & F.max("a") & (F.min("core") != F.max("core"))).alias("formation_roles"),
        F.max("other").alias("other_situation"), F.max("user").alias("user_situation"), (F.max("roles") > 1).alias("repeats"))


def assemble(members: DataFrame) -> DataFrame:
    """One row per window and episode: current before related before revision anchor."""
    rank = F.when(F.col("origin") == "current", 0).when(F.col("origin") == "related", 1).otherwise(2)
    best = members.groupBy("window_ref", "episode_ref").agg(F.min(F.struct(rank.alias("r"), "position", "origin")).alias("b"))
    return best.select("window_ref", "episode_ref", F.col("b.origin").alias("origin"), F.col("b.position").alias("position"))


def formation_possible(members: DataFrame, flags: DataFrame) -> DataFrame:
    """Per window: some current episode pairs with an episode of another session.

    Among usable episodes that is: two sessions in all and one current episode. A source key holds the session,
    so episodes of different sessions never share a source and no pairs are formed.
    """
    usable = flags.filter("formation_roles AND other_situation AND NOT repeats").select("episode_ref", "session_ref")
    seen = members.filter("origin <> 'revision_anchor'").join(usable, "episode_ref")
    got = seen.groupBy("window_ref").agg(
        ((F.min("session_ref") != F.max("session_ref")) & F.max(F.col("origin") == "current")).alias("possible"))
    return members.select("window_ref").distinct().join(got, "window_ref", "left").select(
        "window_ref", F.coalesce("possible", F.lit(False)).alias("formation_possible"))


def formation_basis(basis: DataFrame, members: DataFrame, flags: DataFrame, sources: DataFrame,
                    outcomes: DataFrame) -> DataFrame:
    """Per change whether its basis may form a disposition.

    ``basis``: window_ref, change_no, ref (one row each); ``sources``: flat episode sources; ``outcomes``:
    window_ref, outcome_ref, episode_ref, actor_kind. Needs two episodes of two sessions, usable roles, no source
    cited twice, and only non-agent outcomes of cited episodes.
    """
    key = ["window_ref", "change_no"]
    m = members.filter("origin <> 'revision_anchor'").select("window_ref", F.col("episode_ref").alias("ref"), F.lit(True).alias("is_episode"))
    f = flags.select(F.col("episode_ref").alias("ref"), "session_ref", (F.col("formation_roles") & F.col("other_situation")).alias("usable"))
    o = outcomes.filter("actor_kind NOT IN ('agent', '')").select(
        "window_ref", F.col("outcome_ref").alias("ref"), F.col("episode_ref").alias("outcome_episode"))
    rows = basis.join(m.distinct(), ["window_ref", "ref"], "left").join(f, "ref", "left").join(o.distinct(), ["window_ref", "ref"], "left")
    episode = F.coalesce("is_episode", F.lit(False))
    per = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("refs"), F.count_distinct("ref").alias("distinct_refs"),
        F.count_if(episode).alias("episodes"),
        F.count_distinct(F.when(episode, F.col("session_ref"))).alias("sessions"),
        F.max(episode & ~F.coalesce("usable", F.lit(False))).alias("unusable"),
        F.max(~episode & F.col("outcome_episode").isNull()).alias("unknown"))
    cited = rows.filter("is_episode").select(*key, F.col("ref").alias("episode_ref"))
    twice = cited.join(sources.select("episode_ref", "session_ref", "source_ref"), "episode_ref").groupBy(
        *key, "session_ref", "source_ref").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key).distinct().withColumn("twice", F.lit(True))
    stray = rows.filter("is_episode IS NULL AND outcome_episode IS NOT NULL").select(
        *key, F.col("outcome_episode").alias("episode_ref")).join(cited, [*key, "episode_ref"], "left_anti").select(
        *key).distinct().withColumn("stray", F.lit(True))
    ok = ((F.col("refs") == F.col("distinct_refs")) & (F.col("episodes") >= 2) & (F.col("sessions") >= 2)
          & ~F.col("unusable") & ~F.col("unknown") & F.col("twice").isNull() & F.col("stray").isNull())
    return per.join(twice, key, "left").join(stray, key, "left").select(*key, ok.alias("eligible"))


def adaptation_basis(basis: DataFrame, members: DataFrame, flags: DataFrame) -> DataFrame:
    """Per change whether its basis is exactly one current episode with a situation written by a user."""
    m = members.filter("origin = 'current'").select("window_ref", F.col("episode_ref").alias("ref"))
    f = flags.filter("user_situation").select(F.col("episode_ref").alias("ref"), F.lit(True).alias("good"))
    good = m.join(f, "ref")
    return basis.join(good.distinct(), ["window_ref", "ref"], "left").groupBy("window_ref", "change_no").agg(
        ((F.count(F.lit(1)) == 1) & F.max(F.coalesce("good", F.lit(False)))).alias("eligible"))


def one_outcome(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """The outcome of episodes that have exactly one with text and not by the agent."""
    fit = outcomes.filter(~F.col("actor_kind").isin("agent", "") & (trimmed("text") != ""))
    return fit.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("outcome_ref").alias("outcome_ref"),
                                F.min("text").alias("outcome_text")).filter("n = 1").drop("n")


def formation_pairs(members: DataFrame, flags: DataFrame, window_outcomes: DataFrame, outcomes: DataFrame,
                    ranking: DataFrame, history: int = 2) -> DataFrame:
    """The anchor of each window and up to ``history`` candidates from other sessions, in rank order.

    ``ranking``: window_ref, episode_ref, rank (fused order; owner already checked by the caller's join).
    """
    usable = flags.filter("formation_roles AND other_situation AND session_ref <> ''").select("episode_ref", "session_ref")
    in_window = one_outcome(window_outcomes, ["window_ref", "episode_ref"]).select("window_ref", "episode_ref", F.col("outcome_ref").alias("seen_ref"))
    whole = one_outcome(outcomes, ["episode_ref"])
    anchors = members.filter("origin = 'current'").join(usable, "episode_ref").join(in_window, ["window_ref", "episode_ref"]).groupBy("window_ref").agg(
        F.max_by(F.struct("episode_ref", "session_ref", "seen_ref"), "position").alias("a")).select("window_ref", "a.*")
    # the outcome must be the only one of the episode altogether, not just within the window
    anchors = anchors.join(whole, "episode_ref").filter("seen_ref = outcome_ref").drop("seen_ref")
    offered = ranking.join(usable, "episode_ref").join(whole, "episode_ref").join(
        anchors.select("window_ref", F.col("episode_ref").alias("__a"), F.col("session_ref").alias("__s")), "window_ref").filter(
        "episode_ref <> __a AND session_ref <> __s")
    per_session = offered.groupBy("window_ref", "session_ref").agg(
        F.min_by(F.struct("rank", "episode_ref", "outcome_ref", "outcome_text"), F.struct("rank", "episode_ref")).alias("c")).select(
        "window_ref", "session_ref", "c.*")
    chosen = top_n(per_session, ["window_ref"], ["rank", "episode_ref"], history, "place")
    cols = ["window_ref", "place", "episode_ref", "session_ref", "outcome_ref", "outcome_text"]
    first = anchors.join(chosen.select("window_ref").distinct(), "window_ref", "left_semi").withColumn("place", F.lit(0))
    return first.select(cols).unionByName(chosen.select(cols)).withColumn(
        "role", F.when(F.col("place") == 0, "anchor").otherwise("candidate"))


def disposition_materials(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per window the experiences (condition, response, outcome), their basis order and the input text.

    At most three episodes per window are gathered.
    """
    said = sources.filter(trimmed("text") != "")
    texts = said.join(pairs.select("episode_ref").distinct(), "episode_ref", "left_semi").groupBy("episode_ref").agg(
        *[F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.when(cond, F.struct("source_ref", trimmed("text").alias("t")))),
                                                         lambda x: x.isNotNull())), lambda x: x["t"]), "\n").alias(name)
          for name, cond in (("condition", (F.col("role") == "situation") & (F.col("actor_kind") != "agent")),
                             ("response", (F.col("role") == "agent_act") & (F.col("actor_kind") == "agent")))])
    block = F.concat(F.lit("EXPERIENCE\nUSER_CONDITION\n"), quoted_lines("condition"), F.lit("\nAGENT_RESPONSE\n"), quoted_lines("response"),
                     F.lit("\nUSER_OUTCOME\n"), quoted_lines(trimmed("outcome_text")), F.lit("\nEXPERIENCE_END"))
    rows = pairs.join(texts, "episode_ref").withColumn("block", block).withColumn(
        "whole", (F.col("condition") != "") & (F.col("response") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("place", "episode_ref", "outcome_ref", "block")))
    return rows.groupBy("window_ref").agg(ordered.alias("e"), F.min("whole").alias("whole")).select(
        "window_ref", F.when(~F.col("whole"), "incomplete_experience").alias("reason"),
        F.flatten(F.transform("e", lambda x: F.array(x["episode_ref"], x["outcome_ref"]))).alias("basis_refs"),
        F.concat(F.lit("EXPERIENCES_BEGIN\n"), F.array_join(F.transform("e", lambda x: x["block"]), "\n"), F.lit("\nEXPERIENCES_END")).alias("input"))


def recollection_materials(members: DataFrame, sources: DataFrame) -> DataFrame:
    """Per window one row for every current situation of a user, with the window's episodes as basis."""
    m = assemble(members)
    current = m.filter("origin = 'current'")
    basis = current.groupBy("window_ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "episode_ref"))),
                                                          lambda x: x["episode_ref"]).alias("basis_refs"))
    s = sources.select("episode_ref", "source_ref", "role", "actor_kind", "text")
    return current.join(s.filter("role = 'situation' AND actor_kind = 'user'"), "episode_ref").join(basis, "window_ref").select(
        "window_ref", "episode_ref", "source_ref", "text", "basis_refs")


def effective_constitution(members: DataFrame, sources: DataFrame) -> DataFrame:
    """Constitution of the situation of a current episode that was admitted last."""
    rows = members.filter("origin = 'current'").select("window_ref", "episode_ref").distinct().join(
        sources.filter("role = 'situation'"), "episode_ref")
    return rows.groupBy("window_ref").agg(F.max_by(F.struct("constitution_ref", "constitution_text"), "admission_order").alias("c")).select(
        "window_ref", "c.*")


def window_evidence(members: DataFrame, sources: DataFrame, flags: DataFrame, outcomes: DataFrame, shortlist: DataFrame,
                    limit: int = MAX_WINDOW_BYTES) -> DataFrame:
    """One row per window: text, allowed targets and basis, counts, and ``noop`` if it must not be processed.

    ``shortlist``: window_ref, version_ref (bounded), application_scope, text. ``request_bytes`` is the size of everything
    that would be sent (see ``size_guard``). It is summed from byte lengths without the window's text first; only windows
    whose other parts fit have their texts gathered, so no oversized window ever meets in one task.
    """
    m = assemble(members)
    rows = m.join(sources, "episode_ref").filter("role IN ('situation', 'agent_act')")
    size = rows.groupBy("window_ref").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sent = m.join(sources.select("episode_ref", "session_ref").distinct(), "episode_ref")
    kept = outcomes.join(m.select("window_ref", "episode_ref"), ["window_ref", "episode_ref"], "left_semi")
    parts = size_guard([
        (m.select("window_ref").distinct().withColumn("job_ref", F.col("window_ref")), ["job_ref"]),
        (sent.filter("origin <> 'revision_anchor'"), ["episode_ref"]), (sent, ["episode_ref", "session_ref", "origin"]),
        (rows, ["source_ref", "role", "actor_kind", "actor_ref", "text"]), (kept, ["outcome_ref", "episode_ref", "actor_kind", "actor_ref", "text"]),
        (shortlist, ["version_ref", "version_ref", "application_scope", "text"])], limit=limit)
    fits = parts.filter("NOT noop").select("window_ref")
    parts = parts.select("window_ref", F.col("bytes").alias("__parts"))
    src = F.struct("role", "source_ref", "actor_kind", "actor_ref", "text")
    per_episode = rows.join(fits, "window_ref", "left_semi").filter("origin <> 'revision_anchor'").groupBy(
        "window_ref", "episode_ref", "origin", "position", "session_ref").agg(F.collect_list(src).alias("s"))
    block = F.when(F.col("origin") == "current", render_window_episode("EPISODE", "episode_ref", "session_ref", F.col("s"))).otherwise(
        render_window_episode("RELATED_EPISODE", "episode_ref", "session_ref", F.col("s")))
    blocks = per_episode.select("window_ref", "origin", "position", "episode_ref", block.alias("block")).groupBy("window_ref").agg(
        F.array_sort(F.collect_list(F.struct("position", "origin", "episode_ref", "block"))).alias("b"))
    part = lambda origin: F.array_join(F.transform(F.filter("b", lambda x: x["origin"] == origin), lambda x: x["block"]), "\n")
    related = part("related")
    const = effective_constitution(m, sources)
    counts = m.join(flags.select("episode_ref", "user_situation"), "episode_ref", "left").groupBy("window_ref").agg(
        F.count_if(F.col("origin") == "current").alias("current"), F.count_if(F.col("origin") == "related").alias("related"),
        F.count_if(F.col("origin") == "revision_anchor").alias("anchors"),
        F.count_if((F.col("origin") == "current") & F.coalesce("user_situation", F.lit(False))).alias("direct"))
    can = formation_possible(m, flags)
    # outcomes count as basis only where a disposition may form
    usable = flags.filter("formation_roles AND other_situation").select("episode_ref")
    offered = outcomes.filter("actor_kind NOT IN ('agent', '')").join(usable, "episode_ref", "left_semi").join(
        can.filter("formation_possible"), "window_ref", "left_semi").join(
        m.filter("origin <> 'revision_anchor'").select("window_ref", "episode_ref"), ["window_ref", "episode_ref"], "left_semi")
    n_out = offered.groupBy("window_ref").agg(F.count_distinct("outcome_ref").alias("outcomes"))
    memories = shortlist.groupBy("window_ref").agg(F.sort_array(F.collect_set("version_ref")).alias("memory_refs"))
    none = F.array().cast("array<string>")
    text = F.concat(render_constitution(F.coalesce("constitution_ref", F.lit("")), F.coalesce("constitution_text", F.lit(""))), part("current"),
                    F.when(related != "", F.concat(F.lit("\nRELATED_EPISODES\n"), related)).otherwise(""))
    full = (
        counts.join(size, "window_ref", "left").join(parts, "window_ref").join(can, "window_ref").join(n_out, "window_ref", "left")
        .join(memories, "window_ref", "left").join(const, "window_ref", "left").join(blocks, "window_ref", "left"))
    targets = F.concat(
        F.when(F.col("current") > 0, F.array(F.lit("NEW_RECOLLECTION"))).otherwise(none),
        F.when(F.col("formation_possible") | (F.col("direct") > 0), F.array(F.lit("NEW_DISPOSITION"))).otherwise(none),
        F.coalesce("memory_refs", none))
    collides = F.coalesce(F.array_contains(targets, F.col("constitution_ref")), F.lit(False))
    made = F.filter(targets, lambda x: x.startswith("NEW_"))
    request = F.col("__parts") + F.coalesce(F.octet_length(text), F.lit(0)) + F.octet_length(F.array_join(made, ""))
    return full.select(
        "window_ref", "current", "related", "anchors", "direct", "formation_possible",
        F.coalesce("outcomes", F.lit(0)).alias("outcomes"), targets.alias("targets"), "bytes", request.alias("request_bytes"),
        ((request > limit) | collides).alias("noop"), F.when(request <= limit, text).alias("window_text"))


def size_guard(parts: Sequence[tuple[DataFrame, Sequence[str]]], key: str = "window_ref", limit: int = MAX_WINDOW_BYTES) -> DataFrame:
    """Bytes of the strings of a worker request per window, and whether the window must become a no-op.

    Each part is a table of rows that are sent with a window and the columns that count; a column may be named twice.
    """
    def one(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        lengths = [F.coalesce(F.octet_length(c), F.lit(0)) for c in columns if c in df.columns]
        return df.select(key, sum(lengths[1:], lengths[0]).cast("long").alias("bytes"))

    rows = one(*parts[0])
    for part in parts[1:]:
        rows = rows.unionByName(one(*part))
    return rows.groupBy(key).agg(F.sum("bytes").alias("bytes")).withColumn("noop", F.col("bytes") > limit)


def snippet_alignment(snippets: DataFrame, turns: DataFrame) -> DataFrame:
    """Where an evidence snippet occurs in its history: matched, unmatched or ambiguous.

    ``snippets``: question_ref, conv_id, pos, role, text; ``turns``: conv_id, idx, user_text, agent_text. A user
    message and the assistant message after it form one group. A group fits a turn if its text is contained
    (whole words); a fitting assistant narrows, if any fits. Strictly increasing chains through the groups are
    counted up to two: the chain of the earliest turns and that of the latest ones are minima and maxima, group by group, and no turns are
    gathered. The join is blocked on the group's longest word, which a fitting turn must contain.
    """
    from ..functions.text import contains_observed, normalize_ws

    s = snippets.withColumn("t", normalize_ws("text"))
    w = W.partitionBy("question_ref").orderBy("pos")
    s = s.withColumn("prev", F.lag("role").over(w)).withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("t").over(w))
    groups = s.filter("role = 'user' OR prev IS NULL OR prev <> 'user'").select(
        "question_ref", "conv_id", "pos", F.when(F.col("role") == "user", "user").otherwise("assistant").alias("lead"), "t",
        F.when((F.col("role") == "user") & (F.col("next_role") == "assistant"), F.col("next_text")).alias("reply"))
    groups = groups.withColumn("g", F.row_number().over(W.partitionBy("question_ref").orderBy("pos")))
    sized = F.transform(F.split("t", " "), lambda x: F.struct(F.length(x).alias("n"), x.alias("w")))
    asked = groups.withColumn("word", F.array_max(sized)["w"])
    said = turns.withColumn("u", normalize_ws("user_text")).withColumn("a", normalize_ws("agent_text"))
    words = said.select("conv_id", "idx", F.explode(F.array_distinct(F.concat(
        F.transform(F.array_distinct(F.split("u", " ")), lambda x: F.struct(F.lit("user").alias("lead"), x.alias("word"))),
        F.transform(F.array_distinct(F.split("a", " ")), lambda x: F.struct(F.lit("assistant").alias("lead"), x.alias("word")))))).alias("k")).select(
        "conv_id", "idx", "k.lead", "k.word").distinct()
    # words meet without texts; texts join the pairs that share a group's word
    place = F.struct("conv_id", "idx")
    met = asked.join(words, ["conv_id", "lead", "word"]).withColumn("__at", place)
    hit = met.join(said.select(place.alias("__at"), "u", "a"), "__at").filter(
        contains_observed(F.when(F.col("lead") == "user", F.col("u")).otherwise(F.col("a")), "t"))
    hit = hit.withColumn("backed", F.col("reply").isNotNull() & F.coalesce(contains_observed("a", "reply"), F.lit(False)))
    # a fitting assistant narrows its group to the turns that have it
    hit = cut_lineage(hit.select("question_ref", "g", "idx", "backed").distinct())
    any_ = hit.groupBy("question_ref", "g").agg(F.max("backed").alias("any"))
    fits = hit.join(any_, ["question_ref", "g"]).filter("backed OR NOT any").select("question_ref", "g", "idx")
    total = groups.groupBy("question_ref").agg(F.max("g").alias("groups"))
    fits = cut_lineage(fits.join(total, "question_ref"))
    most = total.agg(F.max("groups")).first()[0] or 0
    # the chain of earliest turns, and that of latest ones from the end: there is one chain if they are the same
    early = late = None
    for step in range(1, most + 1):
        early = _next_turn(fits, early, step, F.col("g") == step, F.min("idx"), F.col("idx") > F.col("chain"))
        late = _next_turn(fits, late, step, F.col("g") == F.col("groups") - (step - 1), F.max("idx"), F.col("idx") < F.col("chain"))
    status, matches = F.lit("unmatched"), F.lit(0)
    if most:
        # by number of the group; a chain that stops early has no turn for the last one
        one = early.withColumn("g", F.col("step"))
        two = late.join(total, "question_ref").withColumn("g", F.col("groups") - F.col("step") + 1).select("question_ref", "g", F.col("chain").alias("other"))
        both = one.join(two, ["question_ref", "g"]).groupBy("question_ref").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("chain") != F.col("other")).alias("apart"))
        total = total.join(both, "question_ref", "left")
        whole = F.coalesce(F.col("n") == F.col("groups"), F.lit(False))
        status = F.when(~whole, "unmatched").when(F.col("apart"), "ambiguous").otherwise("matched")
        matches = F.when(~whole, 0).when(F.col("apart"), 2).otherwise(1)
    return total.select("question_ref", status.alias("status"), matches.alias("matches"))


def _next_turn(fits: DataFrame, chains: DataFrame | None, step: int, group: Column, pick: Column, beyond: Column) -> DataFrame:
    """(question_ref, step, chain) of all steps so far: the chains that go on, with the turn that the next group adds."""
    here = fits.filter(group)
    if chains is None:
        return cut_lineage(here.groupBy("question_ref").agg(pick.alias("chain")).select("question_ref", F.lit(step).alias("step"), "chain"))
    last = chains.filter(F.col("step") == step - 1).select("question_ref", "chain")
    more = here.join(last, "question_ref").filter(beyond).groupBy("question_ref").agg(pick.alias("chain"))
    return cut_lineage(chains.unionByName(more.select("question_ref", F.lit(step).alias("step"), "chain")))
