"""Queries over selection and assembled contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs, text as tx
from ..operators import context, selection
from ..plans.bindings import Tables, sql_with
from .registry import query
from .retrieval import _LANES, dice, lanes, terms
from .sqltext import SCOPE_FIELDS, hash_sql

REQUEST = ["session_ref", "run_ref"]


def versions(t: Tables):
    cols = ["tenant_ref", "scope_kind", "agent_ref", "relationship_ref", "root_ref", "version_ref", "version_number",
            "text", "application_scope", "status", "created_order"]
    return t("recollections").select(*cols, F.lit("recollection").alias("kind")).unionByName(
        t("dispositions").select(*cols, F.lit("disposition").alias("kind")))


def basis(t: Tables):
    return t("recollection_basis").unionByName(t("seed_basis"))


def catalogue(t: Tables):
    """Bounded per owner and kind."""
    both = [selection.bounded_catalogue(t(n)).select("tenant_ref", "scope_kind", "agent_ref", "relationship_ref", "version_ref", F.lit(k).alias("kind"))
            for n, k in (("recollections", "recollection"), ("dispositions", "disposition"))]
    return both[0].unionByName(both[1])


def anchors(t: Tables):
    return selection.memory_anchors(versions(t).filter("status = 'active'"), basis(t), t("episodes"), t("links"), t("sources"))


def request_lanes(t: Tables):
    return selection.visible_owners(t("selects"), REQUEST)


def provider_hits(t: Tables):
    conversation = F.split("session_ref", "-")[1].cast("bigint")
    return lanes(t).withColumns({"tenant_ref": F.concat(F.lit("t"), F.floor(conversation / 100).cast("string")), "agent_ref": F.lit("agent")})


def shared_hits(t: Tables):
    return t.once("provider_hits", lambda: provider_hits(t))


def activations(t: Tables):
    queries = t("select_queries").select(*REQUEST, "query_ref", "text")
    active = versions(t).filter("status = 'active'")
    return selection.select_memories(queries, request_lanes(t), catalogue(t), anchors(t), basis(t), shared_hits(t), active, REQUEST)


_VIEWS = ("recollections", "dispositions", "recollection_basis", "seed_basis", "episodes", "links", "sources", "selects", "select_queries", "index_hits")
_OWN = "scope_kind, relationship_ref"
_V = """v AS (SELECT tenant_ref, scope_kind, agent_ref, relationship_ref, version_ref, text, application_scope, status, created_order, 'recollection' AS kind FROM recollections
  UNION ALL SELECT tenant_ref, scope_kind, agent_ref, relationship_ref, version_ref, text, application_scope, status, created_order, 'disposition' FROM dispositions),
bs AS (SELECT * FROM recollection_basis UNION ALL SELECT * FROM seed_basis),
cat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, tenant_ref, scope_kind, relationship_ref ORDER BY version_ref) AS owner_rank FROM v WHERE status = 'active') WHERE owner_rank <= 40),
anc AS (SELECT DISTINCT v.scope_kind, v.relationship_ref, v.version_ref, v.kind, b.role AS basis_role, e.episode_ref, l.source_ref, s.text AS anchor_text
  FROM v JOIN bs b USING (version_ref) JOIN episodes e ON e.episode_ref = b.episode_ref AND e.scope_kind = v.scope_kind AND e.relationship_ref = v.relationship_ref
  JOIN links l ON l.episode_ref = e.episode_ref AND l.role = 'situation' JOIN sources s ON s.session_ref = l.session_ref AND s.source_ref = l.source_ref WHERE v.status = 'active')"""


@query("w01_bounded_catalogue", sql_with(*_VIEWS, extra=_V) + "SELECT kind, version_ref FROM cat")
def _(t: Tables):
    return catalogue(t).select("kind", "version_ref")


@query("j02_memory_anchors", sql_with(*_VIEWS, extra=_V) + "SELECT version_ref, basis_role, episode_ref, source_ref, anchor_text FROM anc")
def _(t: Tables):
    return anchors(t).select("version_ref", "basis_role", "episode_ref", "source_ref", "anchor_text")


@query("j03_visible_owners", sql_with("selects") + """SELECT session_ref, run_ref, 'agent' AS scope_kind, '' AS relationship_ref, 1 AS owner_order FROM selects
UNION ALL SELECT session_ref, run_ref, 'relationship', relationship_ref, 0 FROM selects WHERE scope_kind = 'relationship'""")
def _(t: Tables):
    return request_lanes(t).select(*REQUEST, "scope_kind", "relationship_ref", "owner_order")


@query("j04_linked_memories", sql_with(*_VIEWS, extra=_V + "," + _LANES) + f"""SELECT DISTINCT h.session_ref, h.run_ref, v.version_ref FROM lanes h JOIN bs b ON b.episode_ref = h.ref JOIN v ON v.version_ref = b.version_ref AND v.scope_kind = h.scope_kind AND v.relationship_ref = h.relationship_ref WHERE h.kind = 'EPISODE'""")
def _(t: Tables):
    hits = provider_hits(t).filter("kind = 'EPISODE'").select(*REQUEST, *selection.OWNER, F.col("ref").alias("episode_ref"))
    return selection.linked_memories(hits, basis(t), versions(t)).select(*REQUEST, "version_ref").distinct()


@query("p06_live_anchors", sql_with("links", "sources") + """SELECT l.episode_ref, l.source_ref FROM links l JOIN sources s USING (session_ref, source_ref) WHERE l.role = 'situation' AND length(s.text) % 5 <> 1""")
def _(t: Tables):
    blanked = t("links").filter("role = 'situation'").join(t("sources").select("session_ref", "source_ref", "text"), ["session_ref", "source_ref"]).withColumn(
        "anchor_text", F.when(F.length("text") % 5 == 1, "").otherwise(F.col("text")))
    return selection.live_anchors(blanked).select("episode_ref", "source_ref")


@query("a03_reenactment_count", sql_with("seed_basis") + "SELECT version_ref, least(count(DISTINCT episode_ref), 4) AS availability FROM seed_basis WHERE role = 'reenactment' GROUP BY 1")
def _(t: Tables):
    return selection.reenactment_count(t("seed_basis")).select("version_ref", "availability")


@query("a04_learned_basis", sql_with(*_VIEWS, extra=_V) + "SELECT DISTINCT b.version_ref, b.episode_ref FROM bs b JOIN v USING (version_ref) WHERE v.status = 'active'")
def _(t: Tables):
    return selection.learned_basis(versions(t), basis(t)).select("version_ref", "episode_ref")


# the whole selection: lanes, bounded catalogue, index hits, paths, inhibition, quotas
_SELECT = _V + "," + _LANES + f""",
own AS (SELECT tenant_ref, session_ref, run_ref, 'agent' AS scope_kind, '' AS relationship_ref, 1 AS owner_order FROM selects
  UNION ALL SELECT tenant_ref, session_ref, run_ref, 'relationship', relationship_ref, 0 FROM selects WHERE scope_kind = 'relationship'),
act AS (SELECT * FROM v WHERE status = 'active' AND text <> ''),
sup AS (SELECT * FROM anc WHERE basis_role <> 'inhibition'),
evd AS (SELECT version_ref, scope_kind, relationship_ref, min(row(episode_ref, source_ref, anchor_text)) AS e FROM sup GROUP BY ALL),
want AS (SELECT o.session_ref, o.run_ref, c.scope_kind, c.relationship_ref, c.kind, c.version_ref FROM own o JOIN cat c USING (tenant_ref, {_OWN})
  UNION SELECT session_ref, run_ref, scope_kind, relationship_ref, lower(kind), ref FROM lanes WHERE kind <> 'EPISODE'
  UNION SELECT h.session_ref, h.run_ref, v.scope_kind, v.relationship_ref, v.kind, v.version_ref FROM lanes h JOIN bs b ON b.episode_ref = h.ref
    JOIN v ON v.version_ref = b.version_ref AND v.scope_kind = h.scope_kind AND v.relationship_ref = h.relationship_ref WHERE h.kind = 'EPISODE'),
mt AS (SELECT version_ref, {terms('text')} AS b FROM act),
qt AS (SELECT session_ref, run_ref, query_ref, {terms('text')} AS a FROM select_queries),
ant AS (SELECT DISTINCT source_ref, anchor_text, {terms('anchor_text')} AS b FROM anc),
cnd AS (SELECT w.*, e.e FROM want w JOIN act a USING ({_OWN}, kind, version_ref) JOIN evd e USING ({_OWN}, version_ref)),
dir AS (SELECT c.session_ref, c.run_ref, c.scope_kind, c.relationship_ref, c.kind, c.version_ref, q.query_ref, {dice('q.a', 'm.b')} AS score, c.version_ref AS matched_ref, c.e[1] AS ee, c.e[2] AS es
  FROM cnd c JOIN qt q USING (session_ref, run_ref) JOIN mt m ON m.version_ref = c.version_ref),
met AS (SELECT c.session_ref, c.run_ref, c.scope_kind, c.relationship_ref, c.kind, c.version_ref, x.basis_role, x.episode_ref, x.source_ref, q.query_ref, {dice('q.a', 't.b')} AS score
  FROM cnd c JOIN anc x USING ({_OWN}, version_ref) JOIN qt q USING (session_ref, run_ref) JOIN ant t ON t.source_ref = x.source_ref AND t.anchor_text = x.anchor_text WHERE c.kind = 'disposition'),
paths AS (SELECT session_ref, run_ref, kind, version_ref, query_ref, score, matched_ref, ee, es, false AS indexed, 0 AS rank, 0 AS lane, true AS direct FROM dir
  UNION ALL SELECT d.session_ref, d.run_ref, d.kind, d.version_ref, d.query_ref, score, matched_ref, ee, es, true, h.rank, h.lane_order, true FROM dir d
    JOIN lanes h ON h.session_ref = d.session_ref AND h.run_ref = d.run_ref AND h.scope_kind = d.scope_kind AND h.relationship_ref = d.relationship_ref AND lower(h.kind) = d.kind AND h.ref = d.version_ref AND h.query_ref = d.query_ref
  UNION ALL SELECT session_ref, run_ref, kind, version_ref, query_ref, score, source_ref, episode_ref, source_ref, false, 0, 0, false FROM met WHERE basis_role <> 'inhibition'
  UNION ALL SELECT m.session_ref, m.run_ref, m.kind, m.version_ref, m.query_ref, arg_min(score, source_ref), m.episode_ref, m.episode_ref, min(source_ref), true, h.rank, h.lane_order, false FROM met m
    JOIN lanes h ON h.session_ref = m.session_ref AND h.run_ref = m.run_ref AND h.scope_kind = m.scope_kind AND h.relationship_ref = m.relationship_ref AND h.kind = 'EPISODE' AND h.ref = m.episode_ref AND h.query_ref = m.query_ref
    WHERE basis_role <> 'inhibition' GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_ref, run_ref, kind, version_ref ORDER BY indexed DESC, rank, lane, score DESC, direct DESC, query_ref, matched_ref, ee, es) AS r FROM paths) WHERE r = 1),
inh AS (SELECT session_ref, run_ref, version_ref, max(score) AS inhibition FROM met WHERE basis_role = 'inhibition' GROUP BY 1, 2, 3),
av AS (SELECT version_ref, least(count(DISTINCT episode_ref), 4) AS availability FROM seed_basis WHERE role = 'reenactment' GROUP BY 1),
fin AS (SELECT b.*, o.owner_order, coalesce(av.availability, 0) AS availability FROM best b JOIN v ON v.version_ref = b.version_ref
  JOIN own o ON o.session_ref = b.session_ref AND o.run_ref = b.run_ref AND o.scope_kind = v.scope_kind AND o.relationship_ref = v.relationship_ref
  LEFT JOIN inh i ON i.session_ref = b.session_ref AND i.run_ref = b.run_ref AND i.version_ref = b.version_ref LEFT JOIN av ON av.version_ref = b.version_ref
  WHERE (b.indexed OR b.score >= 0.2) AND (b.kind <> 'disposition' OR i.inhibition IS NULL OR b.score > i.inhibition)),
quo AS (SELECT *, row_number() OVER (PARTITION BY session_ref, run_ref, kind ORDER BY indexed DESC, rank, lane, score DESC, owner_order, availability DESC, kind, version_ref) AS kr FROM fin),
sel AS (SELECT session_ref, run_ref, kind, version_ref, query_ref, matched_ref, ee AS evidence_episode, es AS evidence_source, indexed,
  row_number() OVER (PARTITION BY session_ref, run_ref ORDER BY indexed DESC, rank, lane, score DESC, owner_order, availability DESC, kind, version_ref) - 1 AS item_order FROM quo WHERE kr <= 8)"""


@query("c10_select_job", sql_with(*_VIEWS, extra=_SELECT) + "SELECT * FROM sel")
def _(t: Tables):
    return activations(t).select(*REQUEST, "kind", "version_ref", "query_ref", "matched_ref", "evidence_episode", "evidence_source", "indexed",
                                 F.col("item_order").cast("bigint").alias("item_order"))


@query("u02_union_candidates", sql_with(*_VIEWS, extra=_V + "," + _LANES) + f"""SELECT session_ref, run_ref, kind, version_ref, CAST(sum(m) AS BIGINT) AS matches FROM (
 SELECT o.session_ref, o.run_ref, c.kind, c.version_ref, 0 AS m FROM (SELECT tenant_ref, session_ref, run_ref, 'agent' AS scope_kind, '' AS relationship_ref FROM selects UNION ALL SELECT tenant_ref, session_ref, run_ref, scope_kind, relationship_ref FROM selects WHERE scope_kind = 'relationship') o JOIN cat c USING (tenant_ref, {_OWN})
 UNION ALL SELECT h.session_ref, h.run_ref, v.kind, v.version_ref, 1 FROM lanes h JOIN v ON v.version_ref = h.ref AND v.scope_kind = h.scope_kind AND v.relationship_ref = h.relationship_ref AND v.status = 'active') GROUP BY ALL""")
def _(t: Tables):
    canonical = selection.offered(request_lanes(t), catalogue(t), REQUEST).withColumn("matches", F.lit(0))
    active = versions(t).filter("status = 'active'").select(*selection.OWNER, "version_ref", F.col("kind").alias("k"))
    indexed = provider_hits(t).withColumnRenamed("ref", "version_ref").drop("kind").join(active, [*selection.OWNER, "version_ref"]).withColumn("matches", F.lit(1)).withColumnRenamed("k", "kind")
    return selection.union_candidates(canonical, indexed, REQUEST)


@query("t08_best_path", sql_with(*_VIEWS, extra=_LANES) + """SELECT session_ref, run_ref, kind, ref AS version_ref, query_ref, CAST(rank AS BIGINT) AS index_rank, CAST(lane_order AS BIGINT) AS lane_order FROM (
 SELECT *, row_number() OVER (PARTITION BY session_ref, run_ref, kind, ref ORDER BY kind <> 'EPISODE' DESC, CASE WHEN kind <> 'EPISODE' THEN rank ELSE 0 END, CASE WHEN kind <> 'EPISODE' THEN lane_order ELSE 0 END, length(query_ref) % 3 DESC, rank % 2 = 0 DESC, query_ref, scope_kind) AS r FROM lanes) WHERE r = 1""".replace(
    "CAST(rank AS BIGINT) AS index_rank, CAST(lane_order AS BIGINT) AS lane_order", "CASE WHEN kind <> 'EPISODE' THEN CAST(rank AS BIGINT) ELSE 0 END AS index_rank, CASE WHEN kind <> 'EPISODE' THEN CAST(lane_order AS BIGINT) ELSE 0 END AS lane_order"))
def _(t: Tables):
    paths = provider_hits(t).select(
        *REQUEST, "kind", F.col("ref").alias("version_ref"), (F.col("kind") != "EPISODE").alias("indexed"), F.col("rank").alias("index_rank"), "lane_order",
        (F.length("query_ref") % 3).cast("double").alias("score"), (F.col("rank") % 2 == 0).alias("direct"), "query_ref",
        F.col("scope_kind").alias("matched_ref"), F.lit("").alias("evidence_episode"), F.lit("").alias("evidence_source"))
    return selection.best_paths(paths, REQUEST).select(*REQUEST, "kind", "version_ref", "query_ref", F.col("index_rank").cast("bigint").alias("index_rank"), F.col("lane_order").cast("bigint").alias("lane_order"))


_T9 = """p AS (SELECT session_ref, run_ref, 'disposition' AS kind, ref AS version_ref, kind = 'DISPOSITION' AS indexed, CASE WHEN kind = 'DISPOSITION' THEN rank ELSE 0 END AS rank, CASE WHEN kind = 'DISPOSITION' THEN lane_order ELSE 0 END AS lane,
  (length(ref) % 7) / 8.0 AS score, CASE WHEN rank % 3 = 0 THEN (rank % 5) / 6.0 END AS inhibition, CASE WHEN scope_kind = 'agent' THEN 1 ELSE 0 END AS owner_order, rank % 4 AS availability FROM lanes),
f AS (SELECT * FROM p WHERE (indexed OR score >= 0.2) AND (inhibition IS NULL OR score > inhibition))"""


@query("t09_rank_and_quota", sql_with("index_hits", extra=_LANES + "," + _T9) + """SELECT session_ref, run_ref, version_ref, item_order FROM (
 SELECT *, row_number() OVER (PARTITION BY session_ref, run_ref ORDER BY indexed DESC, rank, lane, score DESC, owner_order, availability DESC, kind, version_ref) - 1 AS item_order FROM f) WHERE item_order < 8""")
def _(t: Tables):
    disp = F.col("kind") == "DISPOSITION"
    best = provider_hits(t).select(
        *REQUEST, F.lit("disposition").alias("kind"), F.col("ref").alias("version_ref"), disp.alias("indexed"),
        F.when(disp, F.col("rank")).otherwise(0).alias("index_rank"), F.when(disp, F.col("lane_order")).otherwise(0).alias("lane_order"),
        ((F.length("ref") % 7) / 8.0).alias("support"), F.when(F.col("rank") % 3 == 0, (F.col("rank") % 5) / 6.0).alias("inhibition"),
        F.when(F.col("scope_kind") == "agent", 1).otherwise(0).alias("owner_order"), (F.col("rank") % 4).alias("availability"))
    return selection.rank_and_quota(best, REQUEST).select(*REQUEST, "version_ref", F.col("item_order").cast("bigint").alias("item_order"))


_EV = """w AS (SELECT session_ref, run_ref, scope_kind, relationship_ref, ref AS episode_ref, min(rank * 1000 + lane_order) AS pos FROM lanes WHERE kind = 'EPISODE' GROUP BY ALL),
rt AS (SELECT session_ref, scope_kind, relationship_ref, episode_ref, string_agg(concat(upper(l.role), ' [', s.actor_kind, ']', chr(10), s.text), chr(10) ORDER BY CASE l.role WHEN 'situation' THEN 0 WHEN 'agent_act' THEN 1 ELSE 2 END, l.source_ref) AS text, list(l.source_ref) AS inside
  FROM links l JOIN sources s USING (tenant_ref, scope_kind, agent_ref, relationship_ref, session_ref, source_ref) GROUP BY ALL),
off AS (SELECT w.session_ref, w.run_ref, s.evidence_bytes, rt.episode_ref, rt.text, row_number() OVER (PARTITION BY w.session_ref, w.run_ref ORDER BY pos, rt.episode_ref) AS n FROM w JOIN selects s ON s.session_ref = w.session_ref AND s.run_ref = w.run_ref
  JOIN rt ON rt.episode_ref = w.episode_ref AND rt.scope_kind = w.scope_kind AND rt.relationship_ref = w.relationship_ref
  WHERE s.evidence_bytes > 0 AND NOT (rt.session_ref = w.session_ref AND rt.scope_kind = s.scope_kind AND rt.relationship_ref = s.relationship_ref AND list_contains(rt.inside, s.source_ref)))"""
_FOLD = """, RECURSIVE_FOLD AS (SELECT session_ref, run_ref, n, episode_ref, text, evidence_bytes, CASE WHEN octet_length(encode(text)) <= evidence_bytes THEN octet_length(encode(text)) ELSE 0 END AS used,
   octet_length(encode(text)) <= evidence_bytes AS kept, CASE WHEN octet_length(encode(text)) <= evidence_bytes THEN 1 ELSE 0 END AS k FROM off WHERE n = 1
 UNION ALL SELECT o.session_ref, o.run_ref, o.n, o.episode_ref, o.text, o.evidence_bytes, f.used + CASE WHEN f.k < 8 AND octet_length(encode(o.text)) <= o.evidence_bytes - f.used THEN octet_length(encode(o.text)) ELSE 0 END,
   f.k < 8 AND octet_length(encode(o.text)) <= o.evidence_bytes - f.used, f.k + CASE WHEN f.k < 8 AND octet_length(encode(o.text)) <= o.evidence_bytes - f.used THEN 1 ELSE 0 END
 FROM RECURSIVE_FOLD f JOIN off o ON o.session_ref = f.session_ref AND o.run_ref = f.run_ref AND o.n = f.n + 1)"""


@query("t10_episode_evidence", sql_with("index_hits", "selects", "links", "sources", extra=_LANES + "," + _EV + _FOLD.replace("RECURSIVE_FOLD", "fold")).replace("WITH ", "WITH RECURSIVE ", 1) +
       "SELECT session_ref, run_ref, episode_ref, CAST(k - 1 AS BIGINT) AS evidence_order, text FROM fold WHERE kept")
def _(t: Tables):
    return evidence(t).select(*REQUEST, "episode_ref", F.col("evidence_order").cast("bigint").alias("evidence_order"), "text")


def evidence(t: Tables, hits=None):
    requests = t("selects").withColumn("situation_refs", F.array("source_ref"))
    return selection.episode_evidence(requests, provider_hits(t) if hits is None else hits, t("episodes"), t("links"), t("sources"), REQUEST)


# the whole job: activations, evidence, what both and the constitution claim, and the context that is frozen
_JOB = _SELECT + "," + _EV + _FOLD.replace("RECURSIVE_FOLD", "fold") + """,
ask AS (SELECT s.session_ref, s.run_ref, s.conv_id, CASE WHEN s.conv_id % 12 = 0 THEN coalesce(x.version_ref, s.constitution_ref) ELSE s.constitution_ref END AS constitution_ref, {hash} AS h FROM selects s LEFT JOIN sel x ON x.session_ref = s.session_ref AND x.run_ref = s.run_ref AND x.item_order = 0),
say AS (SELECT session_ref, run_ref, constitution_ref AS ref, 'constitution' AS kind FROM ask WHERE constitution_ref <> '' UNION SELECT session_ref, run_ref, version_ref, kind FROM sel UNION SELECT session_ref, run_ref, episode_ref, 'episode_evidence' FROM fold WHERE kept),
cl AS (SELECT session_ref, run_ref, count(*) AS claims, bool_or(kinds > 1) AS ambiguous FROM (SELECT session_ref, run_ref, ref, count(DISTINCT kind) AS kinds FROM say GROUP BY 1, 2, 3) GROUP BY 1, 2),
iv AS (SELECT session_ref, run_ref, count(*) AS items, string_agg(version_ref, ',' ORDER BY item_order) AS memory_refs FROM sel GROUP BY 1, 2),
ie AS (SELECT session_ref, run_ref, count(*) AS episodes FROM fold WHERE kept GROUP BY 1, 2)
SELECT a.session_ref, a.run_ref, 'context_' || substr(a.h, 1, 32) AS context_ref, coalesce(iv.memory_refs, '') AS memory_refs, coalesce(iv.items, 0) AS items, coalesce(ie.episodes, 0) AS episodes, coalesce(cl.claims, 0) AS claims,
 CASE WHEN a.conv_id % 5 = 1 THEN 'conflict' WHEN a.conv_id % 5 = 0 THEN 'replay' WHEN coalesce(cl.ambiguous, false) THEN 'ambiguous' ELSE 'frozen' END AS status
FROM ask a LEFT JOIN iv USING (session_ref, run_ref) LEFT JOIN ie USING (session_ref, run_ref) LEFT JOIN cl USING (session_ref, run_ref)"""
_ASKED = [*[f"s.{x}" for x in (*SCOPE_FIELDS, "run_ref", "constitution_ref", "constitution_text")], "s.source_ref"]
_SELECT_HASH = (f"CASE WHEN s.evidence_bytes = 0 THEN {hash_sql('memory-context-request.v2', *_ASKED)} "
                f"ELSE {hash_sql('memory-context-request.episode-evidence.v1', 'CAST(s.evidence_bytes AS VARCHAR)', chr(39) + 'memory-context-request.v2' + chr(39), *_ASKED)} END")


@query("c10_frozen_contexts", sql_with(*_VIEWS, extra=_JOB.replace("{hash}", _SELECT_HASH)).replace("WITH ", "WITH RECURSIVE ", 1))
def _(t: Tables):
    items = t.once("activations", lambda: activations(t).select(*REQUEST, "kind", "version_ref", "item_order"))
    shown = t.once("evidence", lambda: evidence(t, shared_hits(t)).select(*REQUEST, "episode_ref"))
    asked = t("selects").withColumn("request_hash", refs.select_hash(F.array("source_ref"), F.col("evidence_bytes")))
    # some constitutions reuse the name of a memory
    head = items.filter("item_order = 0").select(*REQUEST, F.col("version_ref").alias("first"))
    asked = asked.join(head, REQUEST, "left").withColumn("constitution_ref", F.when(
        F.col("conv_id") % 12 == 0, F.coalesce("first", "constitution_ref")).otherwise(F.col("constitution_ref")))
    store = asked.filter("conv_id % 5 < 2").select(*REQUEST, F.when(F.col("conv_id") % 5 == 0, F.col("request_hash")).otherwise("old").alias("request_hash"))
    return selection.freeze_contexts(asked, items, shown, store, REQUEST)


_CT = "SELECT i.context_ref, i.memory_ref, i.item_kind, coalesce(r.text, d.text) AS text, coalesce(r.application_scope, CASE d.scope_kind WHEN 'agent' THEN 'self' ELSE 'relation' END) AS application_scope FROM context_items i LEFT JOIN recollections r ON i.item_kind = 'recollection' AND r.version_ref = i.memory_ref LEFT JOIN dispositions d ON i.item_kind = 'disposition' AND d.version_ref = i.memory_ref"


@query("j11_context_text", sql_with("context_items", "recollections", "dispositions") + _CT)
def _(t: Tables):
    return selection.context_texts(t("context_items"), t("recollections"), t("dispositions")).select("context_ref", "memory_ref", "item_kind", "text", "application_scope")


def context_rows(t: Tables):
    """Every item of the frozen contexts: constitution, memories, evidence."""
    key = ["tenant_ref", "context_ref"]
    memory = selection.context_texts(t("context_items"), t("recollections"), t("dispositions")).select(
        *key, F.col("item_kind").alias("kind"), "memory_ref", "text", "application_scope", F.col("memory_ref").alias("item_order"))
    constitution = t("contexts").filter("constitution_ref <> ''").select(
        *key, F.lit("constitution").alias("kind"), F.col("constitution_ref").alias("memory_ref"), F.col("constitution_text").alias("text"), F.lit("").alias("application_scope"), F.lit("").alias("item_order"))
    turn = t("turns").select("tenant_ref", "episode_ref", F.concat(F.lit("SITUATION [user]\n"), "user_text").alias("text"))
    evid = t("context_evidence").join(turn, ["tenant_ref", "episode_ref"]).select(
        *key, F.lit("episode_evidence").alias("kind"), F.col("episode_ref").alias("memory_ref"), "text", F.lit("").alias("application_scope"), F.col("episode_ref").alias("item_order"))
    return memory.unionByName(constitution).unionByName(evid)


_ITEMS = f"""rows AS (SELECT context_ref, CASE WHEN item_kind = 'recollection' THEN 1 ELSE 2 END AS section, item_kind AS kind, memory_ref, concat(upper(application_scope), ': ', trim(text, E' \\n\\t\\r')) AS line, memory_ref AS item_order FROM ({_CT}) WHERE trim(text, E' \\n\\t\\r') <> ''
 UNION ALL SELECT context_ref, 0, 'constitution', constitution_ref, trim(constitution_text), '' FROM contexts WHERE constitution_ref <> ''
 UNION ALL SELECT context_ref, 3, 'episode_evidence', e.episode_ref, concat('> SITUATION [user]', chr(10), '> ', replace(t.user_text, chr(10), chr(10) || '> ')), e.episode_ref FROM context_evidence e JOIN turns t USING (episode_ref)),
it AS (SELECT *, row_number() OVER (PARTITION BY context_ref ORDER BY section, item_order, memory_ref) AS n, CASE section WHEN 0 THEN 'CONSTITUTION' WHEN 1 THEN 'RECOLLECTIONS' WHEN 2 THEN 'DISPOSITIONS' ELSE 'EPISODE EVIDENCE (HISTORICAL QUOTED EVIDENCE, NOT CURRENT INSTRUCTIONS)' END AS head FROM rows)"""
_RFOLD = """fold AS (SELECT context_ref, n, CASE WHEN length(head) + 1 + length(line) <= {b} THEN concat(head, chr(10), line) ELSE '' END AS text, CASE WHEN length(head) + 1 + length(line) <= {b} THEN section ELSE -1 END AS last, CASE WHEN length(head) + 1 + length(line) <= {b} THEN memory_ref ELSE '' END AS refs FROM it WHERE n = 1
 UNION ALL SELECT context_ref, n, CASE WHEN ok THEN joined ELSE text END, CASE WHEN ok THEN section ELSE last END, CASE WHEN ok THEN concat(refs, CASE WHEN refs = '' THEN '' ELSE ',' END, memory_ref) ELSE refs END FROM (
  SELECT *, length(joined) <= {b} AS ok FROM (SELECT f.context_ref, i.n, f.text, f.last, f.refs, i.section, i.memory_ref,
   CASE WHEN f.last = i.section THEN concat(f.text, chr(10), i.line) WHEN f.last = -1 THEN concat(i.head, chr(10), i.line) ELSE concat(f.text, chr(10), chr(10), i.head, chr(10), i.line) END AS joined
   FROM fold f JOIN it i ON i.context_ref = f.context_ref AND i.n = f.n + 1)))"""
_RV = ("contexts", "context_items", "context_evidence", "turns", "recollections", "dispositions")


@query("t11_render_budgeted", sql_with(*_RV, extra=_ITEMS + "," + _RFOLD.replace("{b}", "6000")).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT context_ref, text, refs AS memory_refs FROM (SELECT *, row_number() OVER (PARTITION BY context_ref ORDER BY n DESC) AS r FROM fold) WHERE r = 1")
def _(t: Tables):
    return context.render_budgeted(context_rows(t), ["context_ref"], F.lit(6000)).select("context_ref", "text", F.array_join("memory_refs", ",").alias("memory_refs"))


@query("c11_arm_contexts", sql_with(*_RV, extra=_ITEMS + """,
arms AS (SELECT unnest(['none', 'recollection_only', 'seed_enabled']) AS arm)""") + """SELECT c.context_ref, a.arm, coalesce((SELECT string_agg(memory_ref, ',' ORDER BY n) FROM it i WHERE i.context_ref = c.context_ref AND (i.kind = 'recollection' AND a.arm <> 'none' OR i.kind = 'disposition' AND a.arm = 'seed_enabled')), '') AS memory_refs,
 coalesce((SELECT string_agg(block, chr(10) || chr(10) ORDER BY section) FROM (SELECT section, concat(min(head), chr(10), string_agg(line, chr(10) ORDER BY n)) AS block FROM it i WHERE i.context_ref = c.context_ref AND (i.kind = 'recollection' AND a.arm <> 'none' OR i.kind = 'disposition' AND a.arm = 'seed_enabled') GROUP BY section)), '') AS text
FROM contexts c, arms a""")
def _(t: Tables):
    out = context.arm_contexts(context_rows(t), t("contexts"), ["context_ref"], None)
    return out.select("context_ref", "arm", F.array_join("memory_refs", ",").alias("memory_refs"), "text")


@query("x09_frozen_context", sql_with("selects") + """SELECT session_ref, run_ref, arrival, CASE WHEN h <> coalesce(stored, first_value(h) OVER w) THEN 'conflict' WHEN stored IS NULL AND arrival = min(arrival) OVER (PARTITION BY session_ref, run_ref) THEN 'frozen' ELSE 'replay' END AS status FROM (
 SELECT session_ref, run_ref, arrival + c AS arrival, CASE WHEN c = 2 THEN 'other' ELSE 'same' END AS h, CASE WHEN conv_id % 5 = 0 THEN 'same' WHEN conv_id % 5 = 1 THEN 'old' END AS stored FROM (SELECT *, unnest([0, 1, 2]) AS c FROM selects))
 WINDOW w AS (PARTITION BY session_ref, run_ref ORDER BY arrival)""")
def _(t: Tables):
    s = t("selects")
    hashed = s.select(*REQUEST, "arrival", "conv_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("c")).select(
        *REQUEST, (F.col("arrival") + F.col("c")).alias("arrival"), F.when(F.col("c") == 2, "other").otherwise("same").alias("request_hash"))
    frozen = s.filter("conv_id % 5 < 2").select(*REQUEST, F.when(F.col("conv_id") % 5 == 0, "same").otherwise("old").alias("request_hash"))
    return selection.freeze(hashed, frozen, REQUEST).select(*REQUEST, "arrival", "status")
