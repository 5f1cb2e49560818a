"""Memory selection for many requests at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import refs
from ..functions.text import application_scope, clamp, is_latin, render_episode
from ..plans.session import cut_lineage
from ..plans.split import spread, top_n
from .lexical import features, may_reach, packed, score, unpacked

OWNER = list(refs.OWNER)
SCOPE = list(refs.SCOPE)
GROUP = [*SCOPE, "run_ref", "source_group_ref"]

# Fixed values of the selection policy.
MINIMUM_SCORE = 0.2
PER_KIND = 8
AVAILABILITY_CAP = 4
CATALOGUE = 40
EVIDENCE_ENTRIES = 8
#: Parts of an owner's requests that meet its catalogue apart.
_PARTS = 8
#: Requests of an owner that meet its versions in one place of the selection job.
_PART = 128


def visible_owners(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per request and owner lane: the agent always, the relationship too if there is one.

    ``owner_order`` ranks the relationship first; ``owner_index`` numbers lanes in search order.
    """
    agent = F.struct(F.lit("agent").alias("scope_kind"), F.lit("").alias("relationship_ref"),
                     F.lit(1).alias("owner_order"), F.lit(0).alias("owner_index"))
    relation = F.struct(F.lit("relationship").alias("scope_kind"), F.col("relationship_ref"),
                        F.lit(0).alias("owner_order"), F.lit(1).alias("owner_index"))
    lanes = F.when(F.col("scope_kind") == "relationship", F.array(agent, relation)).otherwise(F.array(agent))
    return requests.select(*keys, "tenant_ref", "agent_ref", F.explode(lanes).alias("o")).select(
        *keys, "tenant_ref", "agent_ref", "o.*")


def bounded_catalogue(versions: DataFrame, n: int = CATALOGUE) -> DataFrame:
    """First ``n`` active versions of each owner by reference. The bound comes before any basis join."""
    return top_n(versions.filter("status = 'active'"), OWNER, ["version_ref"], n, "owner_rank")


def offered(lanes: DataFrame, catalogue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every request lane with each version of its owner's bounded catalogue.

    Both tables are small beside what they give, so both are dealt to all partitions, an owner's requests in a few parts. The key is one
    column: owners hold constants, which Spark takes out of a list of keys, and then it would deal and coalesce anew.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(_PARTS)).cast("int")
    place = lambda p: F.struct(*OWNER, p.alias("part"))
    asked = lanes.dropna(subset=OWNER).withColumn("__at", place(part))
    held = catalogue.withColumn("__at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(_PARTS - 1)), place))).drop(*OWNER)
    return spread(asked, "__at").join(spread(held, "__at").hint("shuffle_hash"), "__at").drop("__at")


def live_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors whose episode, source and text are all present."""
    return anchors.filter("episode_ref <> '' AND source_ref <> '' AND anchor_text <> ''")


def memory_anchors(versions: DataFrame, basis: DataFrame, episodes: DataFrame, links: DataFrame,
                   sources: DataFrame) -> DataFrame:
    """Situation texts behind each version; the episode must belong to the version's own owner."""
    v = versions.select(*OWNER, "version_ref").distinct()
    e = episodes.select(*GROUP, "episode_ref")
    situations = links.filter("role = 'situation'").select(*GROUP, "episode_ref", "source_ref")
    texts = sources.select(*SCOPE, "source_ref", F.col("text").alias("anchor_text"))
    return (
        v.join(basis.select("tenant_ref", "version_ref", "episode_ref", F.col("role").alias("basis_role")),
               ["tenant_ref", "version_ref"])
        .join(e, [*OWNER, "episode_ref"]).join(situations, [*GROUP, "episode_ref"])
        .join(texts, [*SCOPE, "source_ref"])
        .select(*OWNER, "version_ref", "basis_role", "episode_ref", "source_ref", "anchor_text").distinct())


def reenactment_count(basis: DataFrame, cap: int = AVAILABILITY_CAP) -> DataFrame:
    """Distinct reenacted episodes per version, capped."""
    return basis.filter("role = 'reenactment'").groupBy("tenant_ref", "version_ref").agg(
        F.least(F.count_distinct("episode_ref"), F.lit(cap)).alias("availability"))


def learned_basis(versions: DataFrame, basis: DataFrame) -> DataFrame:
    """(active version, episode) rows; nested by the caller where a version's basis is known to be small."""
    return versions.filter("status = 'active'").select("tenant_ref", "version_ref").join(
        basis.select("tenant_ref", "version_ref", "episode_ref"), ["tenant_ref", "version_ref"]).distinct()


def linked_memories(episode_hits: DataFrame, basis: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions of the hit's own owner whose basis cites a hit episode.

    ``episode_hits``: owner columns and ``episode_ref``, any request columns are kept.
    """
    # hits meet the episodes of known versions only, which may be few beside all that a basis cites
    cited = versions.select(*OWNER, "version_ref").distinct().join(basis.select("tenant_ref", "version_ref", "episode_ref"), ["tenant_ref", "version_ref"])
    return episode_hits.join(cited, [*OWNER, "episode_ref"]).drop("episode_ref").distinct()


def union_candidates(canonical: DataFrame, indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union by (request, kind, version); ``matches`` counts the index matches that both sides bring."""
    cols = [*keys, "kind", "version_ref", "matches"]
    return canonical.select(cols).unionByName(indexed.select(cols)).groupBy(*keys, "kind", "version_ref").agg(
        F.sum("matches").alias("matches"))


def path_order() -> Column:
    """Total order of activation paths as one comparable struct; the smallest is best."""
    big = F.lit(0)
    return F.struct(
        (~F.col("indexed")).alias("lexical"),
        F.when(F.col("indexed"), F.col("index_rank")).otherwise(big).alias("index_rank"),
        F.when(F.col("indexed"), F.col("lane_order")).otherwise(big).alias("lane_order"),
        (-F.col("score")).alias("minus_score"),
        (~F.col("direct")).alias("by_anchor"),
        "query_ref", "matched_ref", "evidence_episode", "evidence_source")


def best_paths(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best path per request and candidate: an argmin that combines before the shuffle."""
    best = paths.groupBy(*keys, "kind", "version_ref").agg(F.min(path_order()).alias("p"))
    return best.select(*keys, "kind", "version_ref", *_path_columns())


def _path_columns() -> list[Column]:
    """Columns of the path ``p`` that ``path_order`` made."""
    return [(~F.col("p.lexical")).alias("indexed"), F.col("p.index_rank").alias("index_rank"),
            F.col("p.lane_order").alias("lane_order"), (-F.col("p.minus_score")).alias("support"),
            F.col("p.query_ref").alias("query_ref"), F.col("p.matched_ref").alias("matched_ref"),
            F.col("p.evidence_episode").alias("evidence_episode"), F.col("p.evidence_source").alias("evidence_source")]


def rank_and_quota(best: DataFrame, keys: Sequence[str], per_kind: int = PER_KIND) -> DataFrame:
    """Competition and quotas.

    ``best`` additionally holds ``inhibition`` (NULL: none exists), ``owner_order`` and ``availability``. An
    existing inhibition wins ties, also at score zero.
    """
    keys = list(keys)
    strong = best.filter(F.col("indexed") | (F.col("support") >= MINIMUM_SCORE)).filter(
        (F.col("kind") != "disposition") | F.col("inhibition").isNull() | (F.col("support") > F.col("inhibition")))
    order = [F.col("indexed").desc(), "index_rank", "lane_order", F.col("support").desc(), "owner_order",
             F.col("availability").desc(), "kind", "version_ref"]
    kept = top_n(strong, [*keys, "kind"], order, per_kind, "kind_rank")
    placed = top_n(kept, keys, order, 2 * per_kind, "place")
    return placed.withColumn("item_order", F.col("place") - 1).drop("place", "kind_rank")


def select_memories(queries: DataFrame, lanes: DataFrame, catalogue: DataFrame, anchors: DataFrame,
                    basis: DataFrame, hits: DataFrame, active: DataFrame, keys: Sequence[str],
                    ranker: Callable[[Column, Column], Column] = score) -> DataFrame:
    """Ranked activations of every request.

    ``ranker`` scores the ``features`` of a query and a candidate text (0 to 1); another one than the default cannot use the
    bound on term codes, so all pairs of a request and its bounded candidates are scored.

    ``queries``: keys, query_ref, text. ``lanes``: from ``visible_owners``. ``catalogue``/``active``: versions
    with kind, text. ``anchors``: from ``memory_anchors`` for dispositions and recollections. ``hits``: keys,
    owner columns, query_ref, lane_order, rank, kind, ref; they are read twice, so give a table that is cut from its lineage. A request meets at most the bounded catalogue of
    its two owners plus its index hits, so pairs grow with the requests, not with requests times memories.
    Requests and versions are dealt out by owner and part of its requests, and only what won there leaves again: no pair is shuffled.
    """
    keys = list(keys)
    live = cut_lineage(live_anchors(anchors))
    version = [*OWNER, "kind", "version_ref"]
    said = queries.filter("query_ref <> '' AND text <> ''").select(*keys, "query_ref", "text")
    extra = active.select(version).distinct().join(catalogue.select(version), version, "left_anti")
    linked = linked_memories(hits.filter("kind = 'EPISODE'").select(*keys, *OWNER, F.col("ref").alias("episode_ref")), basis, extra).join(
        extra, [*OWNER, "version_ref"]).select(*keys, *version)
    spots = cut_lineage(_spots(said, lanes, hits, linked, keys))
    texts = cut_lineage(_texts(active, _needs(spots, catalogue, live, basis)))
    return rank_and_quota(_decided(_meetings(spots, _speech(texts, live), keys, ranker), keys), keys)


def _spots(said: DataFrame, lanes: DataFrame, hits: DataFrame, linked: DataFrame, keys: list[str]) -> DataFrame:
    """One row per request and owner that it may meet: its queries, its hits there and the versions it wants by them.

    ``orders`` holds the lane's ``owner_order`` and is empty where only hits name the owner. ``part`` is the part of the owner's
    requests, ``n`` their number. All are few for a request, so they are dealt out by request once and stay there.
    """
    lanes = lanes.dropna(subset=[*keys, *OWNER]).select(*keys, *OWNER, "owner_order")
    sizes = lanes.groupBy(*OWNER).agg(F.ceil(F.count(F.lit(1)) / F.lit(_PART)).cast("int").alias("n"))
    laned = lanes.join(sizes, OWNER).select(
        *keys, *OWNER, F.struct("owner_order").alias("order"), "n", F.pmod(F.xxhash64(*keys), F.col("n")).cast("int").alias("part"))
    found = hits.dropna(subset=[*keys, *OWNER]).select(
        *keys, *OWNER, F.struct("query_ref", "kind", "ref", "rank", "lane_order").alias("hit"),
        F.when(F.col("kind") != "EPISODE", F.struct(F.lower("kind").alias("kind"), F.col("ref").alias("version_ref"))).alias("want"))
    wanted = linked.select(*keys, *OWNER, F.struct("kind", "version_ref").alias("want"))
    every = laned.unionByName(found, allowMissingColumns=True).unionByName(wanted, allowMissingColumns=True)
    spots = spread(every, *keys).groupBy(*keys, *OWNER).agg(
        F.collect_list("order").alias("orders"), F.coalesce(F.max("n"), F.lit(1)).alias("n"), F.coalesce(F.max("part"), F.lit(0)).alias("part"),
        F.array_sort(F.collect_list("hit")).alias("hits"), F.collect_set("want").alias("wants"))
    asked = spread(said, *keys).groupBy(*keys).agg(
        F.collect_list(F.struct("query_ref", "text")).alias("queries"), F.max(~is_latin("text")).alias("foreign"))
    return spots.join(asked, keys)


def _needs(spots: DataFrame, catalogue: DataFrame, live: DataFrame, basis: DataFrame) -> DataFrame:
    """Every version that some request may meet, where: the ``parts`` of its owner's requests. Holds references only.

    ``listed``: every request of the owner meets it. ``shared``: another owner has the same reference.
    """
    version = [*OWNER, "kind", "version_ref"]
    owners = spots.filter(F.size("orders") > 0).groupBy(*OWNER).agg(F.max("n").alias("n"), F.max("foreign").alias("foreign"))
    listed = catalogue.select(version).join(owners, OWNER).select(
        *version, F.sequence(F.lit(0), F.col("n") - 1).alias("parts"), "foreign", F.lit(True).alias("listed"))
    met = spots.select(*OWNER, "part", "foreign", F.explode("wants").alias("v")).select(
        *OWNER, "v.*", F.array("part").alias("parts"), "foreign", F.lit(False).alias("listed")).distinct()
    every = listed.unionByName(met).groupBy(version).agg(
        F.array_distinct(F.flatten(F.collect_set("parts"))).alias("parts"), F.max("foreign").alias("foreign"), F.max("listed").alias("listed"))
    evidence = live.filter("basis_role <> 'inhibition'").groupBy(*OWNER, "version_ref").agg(
        F.min(F.struct("episode_ref", "source_ref")).alias("e"))
    owned = F.max(F.struct(*OWNER)).over(W.partitionBy("kind", "version_ref")) != F.min(F.struct(*OWNER)).over(W.partitionBy("kind", "version_ref"))
    return every.withColumn("shared", owned).join(evidence, [*OWNER, "version_ref"]).join(
        reenactment_count(basis), ["tenant_ref", "version_ref"], "left").withColumn(
        "availability", F.when(F.col("kind") == "disposition", F.coalesce("availability", F.lit(0))).otherwise(0))


def _texts(active: DataFrame, needs: DataFrame) -> DataFrame:
    """Terms of the versions in ``needs``; a Latin text stands beside its terms only where a query in another script may meet it."""
    version = [*OWNER, "kind", "version_ref"]
    known = active.filter("text <> '' AND version_ref <> ''").select(*version, "text").join(needs, version)
    return known.withColumn("copies", F.count(F.lit(1)).over(W.partitionBy(version))).withColumn(
        "mf", packed(features("text"), F.col("foreign"))).drop("text", "foreign")


def _speech(texts: DataFrame, live: DataFrame) -> DataFrame:
    """What may speak for a version: its text, and the texts behind a disposition, which support or inhibit it."""
    version = [*OWNER, "kind", "version_ref"]
    told = [*version, "parts", "listed", "shared", "copies", "availability"]
    own = texts.select(*told, F.lit("text").alias("speaks"), "e.*", F.lit(True).alias("first"), "mf", F.lit(None).cast("string").alias("anchor_text"))
    seeds = texts.filter("kind = 'disposition'").select(told).dropDuplicates(version)
    role = F.when(F.col("basis_role") == "inhibition", "inhibition").otherwise("support")
    behind = live.filter("basis_role IS NOT NULL").join(seeds, [*OWNER, "version_ref"]).withColumn("speaks", role)
    # an indexed episode speaks through its first live anchor
    first = F.min("source_ref").over(W.partitionBy(*OWNER, "version_ref", "episode_ref", "speaks"))
    anchors = behind.select(*told, "speaks", "episode_ref", "source_ref", (F.col("source_ref") == first).alias("first"), "anchor_text")
    return own.unionByName(anchors, allowMissingColumns=True)


def _meetings(spots: DataFrame, speech: DataFrame, keys: list[str], ranker: Callable[[Column, Column], Column]) -> DataFrame:
    """Best path and strongest inhibition of every version that a request meets at an owner.

    Queries and what speaks for versions are dealt out by owner and part once; their pairs are met and reduced there and never shuffled.
    Codes of terms show for most pairs that they cannot reach the minimum, which spares the exact score.
    """
    at = [*OWNER, "part"]
    asked = spots.select(*at, *keys, "orders", "hits", "wants", F.explode("queries").alias("q"))
    mine = F.filter("hits", lambda h: h["query_ref"] == F.col("q.query_ref"))
    where = lambda h: F.struct(h["rank"].alias("index_rank"), h["lane_order"].alias("lane_order"))
    asked = spread(asked.select(*at, *keys, "orders", "wants", mine.alias("hits"), F.col("q.query_ref").alias("query_ref"), F.col("q.text").alias("query_text")), *at)
    episode = lambda h: h["kind"] == "EPISODE"
    asked = asked.select(
        *at, *keys, "orders", "wants", "query_ref", features("query_text").alias("qf"),
        F.transform(F.filter("hits", lambda h: ~episode(h)), lambda h: F.struct(F.lower(h["kind"]).alias("kind"), h["ref"].alias("version_ref"))).alias("refs"),
        F.transform(F.filter("hits", lambda h: ~episode(h)), where).alias("refs_at"),
        F.transform(F.filter("hits", episode), lambda h: h["ref"]).alias("episodes"), F.transform(F.filter("hits", episode), where).alias("episodes_at"))
    held = spread(speech.withColumn("part", F.explode("parts")).drop("parts"), *at)
    held = held.withColumn("sf", F.when(F.col("speaks") == "text", unpacked(F.col("mf"))).otherwise(features("anchor_text"))).drop("mf", "anchor_text")

    text, this = F.col("speaks") == "text", F.struct("kind", "version_ref")
    place = F.when(text, F.array_position("refs", this)).when(
        (F.col("speaks") == "support") & F.col("first"), F.array_position("episodes", F.col("episode_ref"))).otherwise(F.lit(0)).cast("int")
    offered_here = (F.col("listed") & (F.size("orders") > 0)) | F.array_contains("wants", this)
    near = may_reach(F.col("qf"), F.col("sf"), MINIMUM_SCORE) if ranker is score else F.lit(True)
    pairs = asked.join(held.hint("merge"), at).filter(
        offered_here & ((F.col("speaks") == "inhibition") | (text & F.col("shared")) | (place > 0) | near))
    hit = F.when(text, F.get("refs_at", place - 1)).otherwise(F.get("episodes_at", place - 1))
    indexed = F.col("place") > 0
    scored = pairs.withColumn("place", place).select(
        *at, *keys, "kind", "version_ref", "orders", "shared", "copies", "availability", "speaks", "query_ref", text.alias("direct"), indexed.alias("indexed"),
        hit["index_rank"].alias("index_rank"), hit["lane_order"].alias("lane_order"),
        F.when(text, F.col("version_ref")).when(indexed, F.col("episode_ref")).otherwise(F.col("source_ref")).alias("matched_ref"),
        F.col("episode_ref").alias("evidence_episode"), F.col("source_ref").alias("evidence_source"), clamp(ranker(F.col("qf"), F.col("sf"))).alias("score"))
    # without an index match a path below the minimum can neither win nor be selected
    path = F.when((F.col("speaks") != "inhibition") & (F.col("indexed") | (F.col("score") >= MINIMUM_SCORE)), path_order())
    return scored.groupBy(*at, *keys, "kind", "version_ref").agg(
        F.min(path).alias("p"), F.max(F.when(F.col("speaks") == "inhibition", F.col("score"))).alias("inhibition"), F.first("orders").alias("orders"),
        F.max("copies").alias("copies"), F.max("availability").alias("availability"), F.max("shared").alias("shared")).filter("p IS NOT NULL OR shared")


def _decided(met: DataFrame, keys: list[str]) -> DataFrame:
    """Best path of every candidate of a request over its owners, once for each lane and copy that offers it."""
    best = spread(met.drop(*OWNER, "part", "shared"), *keys).groupBy(*keys, "kind", "version_ref").agg(
        F.min("p").alias("p"), F.max("inhibition").alias("inhibition"), F.collect_list(F.struct("orders", "copies", "availability")).alias("lanes")).filter("p IS NOT NULL")
    lane = F.flatten(F.transform("lanes", lambda x: F.flatten(F.array_repeat(F.transform(x["orders"], lambda o: F.struct(
        o["owner_order"].alias("owner_order"), x["availability"].alias("availability"))), x["copies"].cast("int")))))
    return best.withColumn("lane", F.explode(lane)).select(
        *keys, "kind", "version_ref", *_path_columns(), "inhibition", "lane.owner_order", "lane.availability")


def bounded_evidence(items: Column, max_bytes: Column, max_items: int = EVIDENCE_ENTRIES) -> Column:
    """Keep whole texts in order while they fit; skip what does not fit and stop at ``max_items``.

    ``items`` is a short ordered array of structs with ``ref`` and ``bytes``.
    """
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        size = item["bytes"]
        fits = (F.size(acc["kept"]) < max_items) & (size <= max_bytes - acc["used"])
        return F.when(fits, F.struct((acc["used"] + size).alias("used"),
                                     F.array_append(acc["kept"], item["ref"]).alias("kept"))).otherwise(acc)

    return F.when(max_bytes <= 0, F.array().cast("array<string>")).otherwise(
        F.aggregate(items, start, step, lambda acc: acc["kept"]))


def episode_evidence(requests: DataFrame, hits: DataFrame, episodes: DataFrame, links: DataFrame, sources: DataFrame,
                     keys: Sequence[str]) -> DataFrame:
    """Episode evidence per request in (rank, lane) order within the byte budget.

    ``requests``: keys, scope, evidence_bytes, situation refs (array). Texts longer than every budget that wants them
    can never be kept, so they are dropped by their byte length before anything is rendered, and at most the hits of a
    request's lanes are gathered.
    """
    keys = list(keys)
    wanted = hits.filter("kind = 'EPISODE'").groupBy(*keys, *OWNER, F.col("ref").alias("episode_ref")).agg(
        F.min(F.struct("rank", "lane_order", "query_ref")).alias("at"))
    budget = requests.filter("evidence_bytes > 0").select(
        *keys, "evidence_bytes", "situation_refs", F.struct(*SCOPE).alias("__scope"))
    content = links.join(sources.select(*SCOPE, "source_ref", "actor_kind", "text"), [*SCOPE, "source_ref"]).join(
        wanted.select(*OWNER, "episode_ref").distinct(), [*OWNER, "episode_ref"], "left_semi")
    size = content.groupBy(*SCOPE, "episode_ref").agg(F.sum(F.octet_length("text")).alias("bytes"))
    room = wanted.join(budget.select(*keys, "evidence_bytes"), keys).groupBy(*OWNER, "episode_ref").agg(F.max("evidence_bytes").alias("room"))
    small = size.join(room, [*OWNER, "episode_ref"]).filter("bytes <= room").select(*SCOPE, "episode_ref")
    rendered = content.join(small, [*SCOPE, "episode_ref"], "left_semi").groupBy(*SCOPE, "episode_ref").agg(
        F.collect_list(F.struct("role", "source_ref", "actor_kind", "text")).alias("s")).select(
        *OWNER, F.struct(*SCOPE).alias("__at"), "episode_ref", render_episode(F.col("s")).alias("text"),
        F.transform("s", lambda s: s["source_ref"]).alias("inside"))
    # requests meet lengths; texts join the few that are kept
    rendered = cut_lineage(rendered.withColumn("bytes", F.octet_length("text")))
    joined = wanted.join(budget, keys).join(rendered.drop("text"), [*OWNER, "episode_ref"])
    current = (F.col("__scope") == F.col("__at")) & F.arrays_overlap("inside", "situation_refs")
    offered = joined.filter(~current & (F.col("bytes") <= F.col("evidence_bytes"))).groupBy(*keys).agg(
        F.max("evidence_bytes").alias("evidence_bytes"),
        F.array_sort(F.collect_list(F.struct("at", F.col("episode_ref").alias("ref"), "bytes", F.struct(*OWNER, "__at").alias("own")))).alias("items"))
    kept = offered.select(*keys, "items", bounded_evidence(F.col("items"), F.col("evidence_bytes")).alias("kept"))
    chosen = kept.select(*keys, F.posexplode("kept").alias("evidence_order", "episode_ref"), "items").select(
        *keys, "evidence_order", "episode_ref", F.filter("items", lambda i: i["ref"] == F.col("episode_ref"))[0]["own"].alias("own"))
    place = [F.col(f"own.{c}").alias(c) for c in (*OWNER, "__at") if c not in keys]
    return chosen.select(*keys, "evidence_order", "episode_ref", *place).join(
        rendered.select(*OWNER, "__at", "episode_ref", "text"), [*OWNER, "__at", "episode_ref"]).select(*keys, "evidence_order", "episode_ref", "text")


def context_texts(items: DataFrame, recollections: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Text and application of frozen items: from the recollection, else from the disposition."""
    r = recollections.select("tenant_ref", F.col("version_ref").alias("memory_ref"), F.lit("recollection").alias("item_kind"),
                             F.col("text").alias("__rt"), F.col("application_scope").alias("__ra"))
    d = dispositions.select("tenant_ref", F.col("version_ref").alias("memory_ref"), F.lit("disposition").alias("item_kind"),
                            F.col("text").alias("__dt"), F.col("scope_kind").alias("__kind"))
    on = ["tenant_ref", "memory_ref", "item_kind"]
    return items.join(r, on, "left").join(d, on, "left").select(
        *items.columns, F.coalesce("__rt", "__dt").alias("text"),
        F.coalesce("__ra", application_scope("__kind")).alias("application_scope"))


def freeze(requests: DataFrame, frozen: DataFrame, run: Sequence[str]) -> DataFrame:
    """Write-once contexts: adds ``status`` against what is frozen and within the batch.

    The first request of a run wins; the same hash replays, another conflicts.
    """
    run = list(run)
    stored = frozen.select(*run, F.col("request_hash").alias("__stored"))
    first = requests.groupBy(*run).agg(F.min_by("request_hash", "arrival").alias("__first"), F.min("arrival").alias("__at"))
    joined = requests.join(stored, run, "left").join(first, run)
    holder = F.coalesce("__stored", "__first")
    return joined.withColumn("status", F.when(F.col("request_hash") != holder, "conflict").when(
        F.col("__stored").isNull() & (F.col("arrival") == F.col("__at")), "frozen").otherwise("replay")).drop(
        "__stored", "__first", "__at")


def freeze_contexts(requests: DataFrame, items: DataFrame, evidence: DataFrame, frozen: DataFrame, run: Sequence[str]) -> DataFrame:
    """The end of a selection: one row per request with its context, what it shows, and whether it is frozen.

    ``requests``: run columns, arrival, request_hash, constitution_ref. ``items``: run columns, kind, version_ref, item_order (few per request). ``evidence``: run
    columns, episode_ref. A run that has a context replays it or conflicts; else a reference that a context would show as two kinds refuses it.
    """
    run = list(run)
    shown = items.select(*run, F.col("version_ref").alias("ref"), "kind").unionByName(
        requests.filter("constitution_ref <> ''").select(*run, F.col("constitution_ref").alias("ref"), F.lit("constitution").alias("kind"))).unionByName(
        evidence.select(*run, F.col("episode_ref").alias("ref"), F.lit("episode_evidence").alias("kind")))
    claims = shown.groupBy(*run, "ref").agg((F.min("kind") != F.max("kind")).alias("ambiguous")).groupBy(*run).agg(
        F.count(F.lit(1)).alias("claims"), F.max("ambiguous").alias("ambiguous"))
    listed = items.groupBy(*run).agg(F.count(F.lit(1)).alias("items"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("item_order", "version_ref"))), lambda x: x["version_ref"]), ",").alias("memory_refs"))
    episodes = evidence.groupBy(*run).agg(F.count(F.lit(1)).alias("episodes"))
    status = freeze(requests, frozen, run)
    joined = status.join(listed, run, "left").join(episodes, run, "left").join(claims, run, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return joined.select(*run, refs.context_ref(F.col("request_hash")).alias("context_ref"), F.coalesce("memory_refs", F.lit("")).alias("memory_refs"), zero("items"), zero("episodes"), zero("claims"),
                         F.when((F.col("status") == "frozen") & F.coalesce("ambiguous", F.lit(False)), "ambiguous").otherwise(F.col("status")).alias("status"))
