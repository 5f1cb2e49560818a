"""Queries over window evidence, formation, changes and the index log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import changes as ch, evidence as ev, feedback, fusion, index_log, windows
from ..plans.bindings import Tables, sql_with
from ..plans.session import cut_lineage, shared_folder
from ..streaming import index_table
from .intake import chain as delivered_chain
from .registry import query
from .retrieval import _T07, shortlists
from .sqltext import field, hash_blob, list_hex

_EV = ("episodes", "links", "sources", "window_members", "window_outcomes", "outcome_heads", "turns", "model_outputs", "recollections", "dispositions")
_ROWS = """er AS (SELECT e.episode_ref, e.session_ref, e.agent_ref, l.source_ref, l.role, s.actor_kind, s.actor_ref, s.text, s.constitution_ref, s.constitution_text, s.admission_order
 FROM episodes e JOIN links l ON l.episode_ref = e.episode_ref AND l.session_ref = e.session_ref JOIN sources s ON s.session_ref = l.session_ref AND s.source_ref = l.source_ref),
fl AS (SELECT episode_ref, session_ref, count(DISTINCT CASE WHEN role = 'situation' OR (role = 'agent_act' AND actor_kind = 'agent' AND actor_ref = agent_ref) THEN source_ref END) > 1 AND bool_or(role = 'situation') AND bool_or(role = 'agent_act' AND actor_kind = 'agent' AND actor_ref = agent_ref) AS formation_roles,
 bool_or(role = 'situation' AND actor_kind <> 'agent') AS other_situation, bool_or(role = 'situation' AND actor_kind = 'user') AS user_situation, count(*) > count(DISTINCT source_ref) AS repeats FROM er GROUP BY 1, 2),
asm AS (SELECT window_ref, episode_ref, origin, position FROM (SELECT *, row_number() OVER (PARTITION BY window_ref, episode_ref ORDER BY CASE origin WHEN 'current' THEN 0 WHEN 'related' THEN 1 ELSE 2 END, position) AS r FROM window_members) WHERE r = 1)"""
_E = sql_with(*_EV, extra=_ROWS)


def plain_rows(t: Tables):
    return ev.episode_sources(t("episodes"), t("links"), t("sources"))


def rows(t: Tables):
    return t.once("episode_sources", lambda: plain_rows(t))


def members(t: Tables):
    return t.once("window_members", lambda: t("window_members"))


@query("j01_episode_sources", _E + "SELECT episode_ref, role, source_ref, actor_kind, text FROM er")
def _(t: Tables):
    return plain_rows(t).select("episode_ref", "role", "source_ref", "actor_kind", "text")


@query("p07_formation_flags", _E + "SELECT episode_ref, formation_roles, other_situation, user_situation, repeats FROM fl")
def _(t: Tables):
    return ev.episode_flags(plain_rows(t)).select("episode_ref", "formation_roles", "other_situation", "user_situation", "repeats")


@query("u03_assemble_evidence", _E + "SELECT * FROM asm")
def _(t: Tables):
    return ev.assemble(t("window_members"))


@query("j15_formation_possible", _E + """SELECT w.window_ref, EXISTS (SELECT 1 FROM window_members a JOIN fl x ON x.episode_ref = a.episode_ref, window_members b JOIN fl y ON y.episode_ref = b.episode_ref
 WHERE a.window_ref = w.window_ref AND b.window_ref = w.window_ref AND a.origin = 'current' AND b.origin <> 'revision_anchor' AND x.formation_roles AND x.other_situation AND NOT x.repeats AND y.formation_roles AND y.other_situation AND NOT y.repeats AND x.session_ref <> y.session_ref) AS formation_possible
FROM (SELECT DISTINCT window_ref FROM window_members) w""")
def _(t: Tables):
    return ev.formation_possible(members(t), ev.episode_flags(rows(t)))


_BASIS = """bas AS (SELECT DISTINCT window_ref, CAST(1 AS INT) AS change_no, episode_ref AS ref FROM window_members WHERE origin <> 'revision_anchor'
 UNION ALL SELECT DISTINCT window_ref, CAST(2 AS INT), episode_ref FROM window_members WHERE position % 1000 < 2
 UNION ALL SELECT DISTINCT window_ref, CAST(2 AS INT), outcome_ref FROM window_outcomes WHERE length(outcome_ref) % 2 = 0
 UNION ALL SELECT window_ref, CAST(3 AS INT), min(episode_ref) FROM window_members WHERE origin = 'current' GROUP BY 1)"""


def basis_rows(t: Tables):
    m = members(t)
    row = lambda df, no, ref: df.select("window_ref", F.lit(no).alias("change_no"), F.col(ref).alias("ref")).distinct()
    return (
        row(m.filter("origin <> 'revision_anchor'"), 1, "episode_ref").unionByName(row(m.filter("position % 1000 < 2"), 2, "episode_ref"))
        .unionByName(row(t("window_outcomes").filter("length(outcome_ref) % 2 = 0"), 2, "outcome_ref"))
        .unionByName(m.filter("origin = 'current'").groupBy("window_ref").agg(F.min("episode_ref").alias("ref")).select("window_ref", F.lit(3).alias("change_no"), "ref")))


_J14 = """cls AS (SELECT b.window_ref, b.change_no, b.ref, m.episode_ref IS NOT NULL AS is_ep, f.session_ref, f.formation_roles AND f.other_situation AS usable, o.episode_ref AS oe FROM bas b
 LEFT JOIN (SELECT DISTINCT window_ref, episode_ref FROM window_members WHERE origin <> 'revision_anchor') m ON m.window_ref = b.window_ref AND m.episode_ref = b.ref
 LEFT JOIN fl f ON f.episode_ref = b.ref LEFT JOIN (SELECT DISTINCT window_ref, outcome_ref, episode_ref FROM window_outcomes WHERE actor_kind <> 'agent') o ON o.window_ref = b.window_ref AND o.outcome_ref = b.ref)"""


@query("j14_formation_basis", sql_with(*_EV, extra=_ROWS + "," + _BASIS + "," + _J14) + """SELECT window_ref, change_no, bool_and(is_ep OR oe IS NOT NULL) AND count_if(is_ep) >= 2 AND bool_and(NOT is_ep OR usable) AND count(DISTINCT CASE WHEN is_ep THEN session_ref END) >= 2
 AND NOT EXISTS (SELECT 1 FROM cls x JOIN er ON er.episode_ref = x.ref WHERE x.window_ref = c.window_ref AND x.change_no = c.change_no AND x.is_ep GROUP BY er.session_ref, er.source_ref HAVING count(*) > 1)
 AND NOT EXISTS (SELECT 1 FROM cls x WHERE x.window_ref = c.window_ref AND x.change_no = c.change_no AND NOT x.is_ep AND x.oe IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cls y WHERE y.window_ref = x.window_ref AND y.change_no = x.change_no AND y.is_ep AND y.ref = x.oe)) AS eligible
FROM cls c GROUP BY window_ref, change_no""")
def _(t: Tables):
    r = rows(t)
    return ev.formation_basis(basis_rows(t), members(t), ev.episode_flags(r), r, t("window_outcomes"))


@query("j14_adaptation_basis", sql_with(*_EV, extra=_ROWS + "," + _BASIS) + """SELECT b.window_ref, b.change_no, count(*) = 1 AND bool_or(f.user_situation AND m.episode_ref IS NOT NULL) AS eligible FROM bas b LEFT JOIN fl f ON f.episode_ref = b.ref
 LEFT JOIN (SELECT DISTINCT window_ref, episode_ref FROM window_members WHERE origin = 'current') m ON m.window_ref = b.window_ref AND m.episode_ref = b.ref GROUP BY 1, 2""")
def _(t: Tables):
    return ev.adaptation_basis(basis_rows(t), members(t), ev.episode_flags(rows(t)))


# what is sent with a window but its text: job, basis, episodes, their sources, outcomes; the limit lies among the windows' sizes
_SENT = """sent AS (SELECT DISTINCT window_ref, octet_length(encode(window_ref)) AS b, 'job' AS what, '' AS x FROM asm
 UNION ALL SELECT window_ref, octet_length(encode(episode_ref)), 'basis', episode_ref FROM asm WHERE origin <> 'revision_anchor'
 UNION ALL SELECT DISTINCT window_ref, octet_length(encode(episode_ref)) + octet_length(encode(session_ref)) + octet_length(encode(origin)), 'episode', episode_ref FROM asm JOIN er USING (episode_ref)
 UNION ALL SELECT window_ref, octet_length(encode(source_ref)) + octet_length(encode(role)) + octet_length(encode(actor_kind)) + octet_length(encode(actor_ref)) + octet_length(encode(text)), 'source', episode_ref FROM asm JOIN er USING (episode_ref) WHERE role <> 'outcome'
 UNION ALL SELECT o.window_ref, octet_length(encode(o.outcome_ref)) + octet_length(encode(o.episode_ref)) + octet_length(encode(o.actor_kind)) + octet_length(encode(o.actor_ref)) + octet_length(encode(o.text)), 'outcome', o.outcome_ref FROM window_outcomes o JOIN asm USING (window_ref, episode_ref))"""


@query("p08_size_guard", sql_with(*_EV, extra=_ROWS + "," + _SENT) + "SELECT window_ref, CAST(sum(b) AS BIGINT) AS bytes, sum(b) > 9000 AS noop FROM sent GROUP BY 1")
def _(t: Tables):
    m, r = ev.assemble(members(t)), rows(t)
    sent = m.join(r.select("episode_ref", "session_ref").distinct(), "episode_ref")
    return ev.size_guard([
        (m.select("window_ref").distinct().withColumn("job_ref", F.col("window_ref")), ["job_ref"]), (m.filter("origin <> 'revision_anchor'"), ["episode_ref"]),
        (sent, ["episode_ref", "session_ref", "origin"]), (m.join(r, "episode_ref").filter("role <> 'outcome'"), ["source_ref", "role", "actor_kind", "actor_ref", "text"]),
        (t("window_outcomes").join(m.select("window_ref", "episode_ref"), ["window_ref", "episode_ref"], "left_semi"), ["outcome_ref", "episode_ref", "actor_kind", "actor_ref", "text"])], limit=9000)


_PAIRS = """ok AS (SELECT episode_ref, session_ref FROM fl WHERE formation_roles AND other_situation),
ow AS (SELECT window_ref, episode_ref, min(outcome_ref) AS outcome_ref FROM window_outcomes WHERE actor_kind <> 'agent' AND trim(text) <> '' GROUP BY 1, 2 HAVING count(*) = 1),
oo AS (SELECT episode_ref, min(outcome_ref) AS outcome_ref, min(text) AS text FROM outcome_heads WHERE actor_kind <> 'agent' AND trim(text) <> '' GROUP BY 1 HAVING count(*) = 1),
an AS (SELECT window_ref, episode_ref, session_ref, outcome_ref, text FROM (SELECT m.window_ref, m.episode_ref, ok.session_ref, oo.outcome_ref, oo.text, row_number() OVER (PARTITION BY m.window_ref ORDER BY position DESC) AS r FROM window_members m JOIN ok USING (episode_ref) JOIN ow ON ow.window_ref = m.window_ref AND ow.episode_ref = m.episode_ref JOIN oo ON oo.episode_ref = m.episode_ref WHERE m.origin = 'current') WHERE r = 1),
cd AS (SELECT *, row_number() OVER (PARTITION BY window_ref ORDER BY position, episode_ref) AS place FROM (SELECT m.window_ref, m.episode_ref, ok.session_ref, oo.outcome_ref, oo.text, m.position, row_number() OVER (PARTITION BY m.window_ref, ok.session_ref ORDER BY m.position, m.episode_ref) AS sr
  FROM window_members m JOIN ok USING (episode_ref) JOIN oo USING (episode_ref) JOIN an ON an.window_ref = m.window_ref WHERE m.origin <> 'current' AND ok.session_ref <> an.session_ref) WHERE sr = 1),
pr AS (SELECT window_ref, 0 AS place, episode_ref, outcome_ref, text FROM an WHERE window_ref IN (SELECT window_ref FROM cd) UNION ALL SELECT window_ref, place, episode_ref, outcome_ref, text FROM cd WHERE place <= 2)"""


def pairs(t: Tables):
    m = members(t)
    ranking = m.filter("origin <> 'current'").select("window_ref", "episode_ref", F.col("position").alias("rank"))
    return ev.formation_pairs(m, ev.episode_flags(rows(t)), t("window_outcomes"), t("outcome_heads"), ranking)


@query("c05_formation_candidates", sql_with(*_EV, extra=_ROWS + "," + _PAIRS) + "SELECT window_ref, place, episode_ref, outcome_ref FROM pr")
def _(t: Tables):
    return pairs(t).select("window_ref", F.col("place").cast("bigint").alias("place"), "episode_ref", "outcome_ref")


_Q = "concat('> ', replace({}, chr(10), concat(chr(10), '> ')))"
_WS = "E' \\n\\t\\r'"


@query("c06_formation_materials", sql_with(*_EV, extra=_ROWS + "," + _PAIRS) + f"""SELECT window_ref, string_agg(p.episode_ref || ',' || p.outcome_ref, ',' ORDER BY place) AS basis_refs,
 concat('EXPERIENCES_BEGIN', chr(10), string_agg(concat('EXPERIENCE', chr(10), 'USER_CONDITION', chr(10), {_Q.format(f"trim(t.user_text, {_WS})")}, chr(10), 'AGENT_RESPONSE', chr(10), {_Q.format(f"trim(t.agent_text, {_WS})")}, chr(10), 'USER_OUTCOME', chr(10), {_Q.format(f"trim(p.text, {_WS})")}, chr(10), 'EXPERIENCE_END'), chr(10) ORDER BY place), chr(10), 'EXPERIENCES_END') AS input
FROM pr p JOIN turns t USING (episode_ref) GROUP BY 1""")
def _(t: Tables):
    return ev.disposition_materials(pairs(t), rows(t)).filter("reason IS NULL").select("window_ref", F.array_join("basis_refs", ",").alias("basis_refs"), "input")


@query("c06_recollection_materials", _E + """SELECT a.window_ref, a.episode_ref, er.source_ref, er.text, (SELECT string_agg(x.episode_ref, ',' ORDER BY x.position) FROM asm x WHERE x.window_ref = a.window_ref AND x.origin = 'current') AS basis_refs
FROM asm a JOIN er USING (episode_ref) WHERE a.origin = 'current' AND er.role = 'situation' AND er.actor_kind = 'user'""")
def _(t: Tables):
    return ev.recollection_materials(members(t), rows(t)).withColumn("basis_refs", F.array_join("basis_refs", ","))


@query("f11_render_episode", sql_with("turns", "replies") + """SELECT t.episode_ref, concat('SITUATION [user]', chr(10), t.user_text, chr(10), 'AGENT_ACT [agent]', chr(10), t.agent_text, CASE WHEN r.reply_text IS NULL THEN '' ELSE concat(chr(10), 'OUTCOME [user]', chr(10), r.reply_text) END) AS text FROM turns t LEFT JOIN replies r USING (episode_ref)""")
def _(t: Tables):
    return rendered_episodes(t).select("episode_ref", "text")


def rendered_episodes(t: Tables):
    return plain_rows(t).groupBy("tenant_ref", "agent_ref", "relationship_ref", "episode_ref").agg(
        F.collect_list(F.struct("role", "source_ref", "actor_kind", "text")).alias("s")).withColumn("text", tx.render_episode(F.col("s"))).drop("s")


@query("f12_render_constitution", sql_with("sources") + """SELECT source_ref, CASE WHEN constitution_ref = '' THEN concat('CONSTITUTION', chr(10), 'UNKNOWN', chr(10), chr(10))
 ELSE concat('CONSTITUTION', chr(10), 'MEMORY_REF ', constitution_ref, chr(10), '> ', replace(text, chr(10), concat(chr(10), '> ')), chr(10), 'END_CONSTITUTION', chr(10), chr(10)) END AS rendered FROM sources""")
def _(t: Tables):
    return t("sources").select("source_ref", tx.render_constitution("constitution_ref", F.when(F.col("constitution_ref") == "", "").otherwise(F.col("text"))).alias("rendered"))


@query("f20_formation_query", sql_with("replies") + "SELECT episode_ref, concat('USER_CONDITION', chr(10), user_text, chr(10), 'AGENT_RESPONSE', chr(10), agent_text, chr(10), 'USER_OUTCOME', chr(10), reply_text) AS causal, trim(user_text, E' \\n\\t\\r') AS condition FROM replies")
def _(t: Tables):
    s = F.array(F.struct(F.lit("situation").alias("role"), F.lit("user").alias("actor_kind"), F.lit("u").alias("actor_ref"), F.col("user_text").alias("text")),
                F.struct(F.lit("agent_act").alias("role"), F.lit("agent").alias("actor_kind"), F.col("agent_ref").alias("actor_ref"), F.col("agent_text").alias("text")))
    return t("replies").withColumn("s", s).select("episode_ref", tx.formation_query(F.col("s"), "agent_ref", "reply_text").alias("causal"), tx.condition_query(F.col("s")).alias("condition"))


_WTEXT = """wt AS (SELECT a.window_ref, a.origin, a.position, a.episode_ref, concat(CASE a.origin WHEN 'current' THEN 'EPISODE ' ELSE 'RELATED_EPISODE ' END, a.episode_ref, chr(10), 'SESSION ', er.session_ref, chr(10),
  string_agg(concat(upper(er.role), chr(10), 'ACTOR ', er.actor_kind, ' ', er.actor_ref, chr(10), 'SOURCE ', er.source_ref, chr(10), er.text, chr(10)), '' ORDER BY er.role, er.source_ref)) AS block
 FROM asm a JOIN er USING (episode_ref) WHERE a.origin <> 'revision_anchor' AND er.role <> 'outcome' GROUP BY a.window_ref, a.origin, a.position, a.episode_ref, er.session_ref),
cn AS (SELECT a.window_ref, arg_max(er.constitution_ref, er.admission_order) AS cr, arg_max(er.constitution_text, er.admission_order) AS ct FROM asm a JOIN er USING (episode_ref) WHERE a.origin = 'current' AND er.role = 'situation' GROUP BY 1)"""


_BASE = """bs0 AS (SELECT c.window_ref, (SELECT count(*) FROM asm x WHERE x.window_ref = c.window_ref AND origin = 'current') AS current, (SELECT count(*) FROM asm x WHERE x.window_ref = c.window_ref AND origin = 'related') AS related,
 (SELECT count(*) FROM asm x WHERE x.window_ref = c.window_ref AND origin = 'revision_anchor') AS anchors, CAST((SELECT sum(octet_length(encode(er.text))) FROM asm x JOIN er USING (episode_ref) WHERE x.window_ref = c.window_ref AND er.role <> 'outcome') AS BIGINT) AS bytes,
 concat(CASE WHEN cr = '' THEN concat('CONSTITUTION', chr(10), 'UNKNOWN', chr(10), chr(10)) ELSE concat('CONSTITUTION', chr(10), 'MEMORY_REF ', cr, chr(10), '> ', ct, chr(10), 'END_CONSTITUTION', chr(10), chr(10)) END,
  (SELECT string_agg(block, chr(10) ORDER BY position) FROM wt WHERE wt.window_ref = c.window_ref AND origin = 'current'),
  coalesce((SELECT chr(10) || 'RELATED_EPISODES' || chr(10) || string_agg(block, chr(10) ORDER BY position) FROM wt WHERE wt.window_ref = c.window_ref AND origin = 'related'), '')) AS window_text FROM cn c)"""
_WHOLE = _WTEXT + "," + _SENT + "," + _BASE + "," + _T07 + """,
sl AS (SELECT DISTINCT concat('win-', split_part(x.session_ref, '-', 2)) AS window_ref, r.version_ref, r.application_scope, r.text FROM (SELECT session_ref, version_ref FROM sc WHERE r <= 64
  UNION SELECT h.session_ref, h.ref FROM index_hits h JOIN ac ON ac.tenant_ref = h.tenant_ref AND ac.scope_kind = h.scope_kind AND ac.relationship_ref = h.relationship_ref AND ac.version_ref = h.ref WHERE h.kind = 'RECOLLECTION') x JOIN recollections r USING (version_ref)),
sb AS (SELECT window_ref, list(version_ref ORDER BY version_ref) AS memories, sum(2 * octet_length(encode(version_ref)) + octet_length(encode(application_scope)) + octet_length(encode(text))) AS b FROM sl GROUP BY 1),
fm AS (SELECT w.window_ref, EXISTS (SELECT 1 FROM window_members a JOIN fl x ON x.episode_ref = a.episode_ref, window_members b JOIN fl y ON y.episode_ref = b.episode_ref
 WHERE a.window_ref = w.window_ref AND b.window_ref = w.window_ref AND a.origin = 'current' AND b.origin <> 'revision_anchor' AND x.formation_roles AND x.other_situation AND NOT x.repeats AND y.formation_roles AND y.other_situation AND NOT y.repeats AND x.session_ref <> y.session_ref) AS formation_possible
 FROM (SELECT DISTINCT window_ref FROM window_members) w),
dr AS (SELECT window_ref, count_if(user_situation) AS direct FROM asm JOIN fl USING (episode_ref) WHERE origin = 'current' GROUP BY 1),
oo AS (SELECT o.window_ref, count(DISTINCT o.outcome_ref) AS outcomes FROM window_outcomes o JOIN fl USING (episode_ref) JOIN asm a ON a.window_ref = o.window_ref AND a.episode_ref = o.episode_ref AND a.origin <> 'revision_anchor'
 JOIN fm ON fm.window_ref = o.window_ref AND fm.formation_possible WHERE o.actor_kind NOT IN ('agent', '') AND fl.formation_roles AND fl.other_situation GROUP BY 1),
wh AS (SELECT b.*, coalesce(dr.direct, 0) AS direct, fm.formation_possible, coalesce(oo.outcomes, 0) AS outcomes, cn.cr,
 list_concat(CASE WHEN b.current > 0 THEN ['NEW_RECOLLECTION'] ELSE [] END, CASE WHEN fm.formation_possible OR coalesce(dr.direct, 0) > 0 THEN ['NEW_DISPOSITION'] ELSE [] END) AS made, coalesce(sb.memories, []) AS memories,
 (SELECT sum(x.b) FROM sent x WHERE x.window_ref = b.window_ref) + coalesce(sb.b, 0) + octet_length(encode(b.window_text)) AS parts
 FROM bs0 b JOIN fm USING (window_ref) JOIN cn USING (window_ref) LEFT JOIN dr USING (window_ref) LEFT JOIN oo USING (window_ref) LEFT JOIN sb USING (window_ref))
SELECT window_ref, current, related, anchors, bytes, CASE WHEN size <= {limit} THEN window_text END AS window_text, direct, formation_possible, outcomes, array_to_string(targets, ',') AS targets, CAST(size AS BIGINT) AS request_bytes,
 size > {limit} OR list_contains(targets, cr) AS noop FROM (SELECT *, list_concat(made, memories) AS targets, parts + coalesce(octet_length(encode(array_to_string(made, ''))), 0) AS size FROM wh)"""


@query("c04_window_evidence", sql_with(*_EV, "messages", "index_hits", extra=_ROWS + "," + _WHOLE.replace("{limit}", str(tx.MAX_WINDOW_BYTES))))
def _(t: Tables):
    return evidence(t).withColumn("targets", F.array_join("targets", ","))


def evidence(t: Tables):
    r = rows(t)
    shortlist = shortlists(t).select(F.concat(F.lit("win-"), F.split("session_ref", "-")[1]).alias("window_ref"), "version_ref").join(
        t("recollections").select("version_ref", "application_scope", "text"), "version_ref")
    return ev.window_evidence(members(t), r, ev.episode_flags(r), t("window_outcomes"), shortlist)


# --- model outputs -------------------------------------------------------------------------------
_TGT = """pc AS (SELECT window_ref, conv_id, 0 AS change_no, CASE conv_id % 9 WHEN 0 THEN 'NEW_RECOLLECTION' WHEN 8 THEN 'NEW_DISPOSITION' ELSE split_part(output, chr(10), 2) END AS target, CASE conv_id % 9 WHEN 0 THEN 'OTHER' ELSE split_part(output, chr(10), 4) END AS application,
  CASE conv_id % 9 WHEN 0 THEN 'TEXT' WHEN 5 THEN 'KEEP' WHEN 6 THEN 'TEXT' ELSE 'ADAPT' END AS operation, CASE conv_id % 9 WHEN 0 THEN concat('likes ', CAST(conv_id % 4 AS VARCHAR)) WHEN 6 THEN concat('now ', CAST(conv_id % 3 AS VARCHAR)) WHEN 8 THEN 'stay brief' ELSE '' END AS text,
  list_last(string_split(output, chr(10))) AS basis FROM model_outputs WHERE conv_id % 9 IN (0, 5, 6, 8)
 UNION ALL SELECT window_ref, conv_id, 1, 'NEW_RECOLLECTION', 'SELF', 'TEXT', concat('says ', CAST(conv_id AS VARCHAR)), list_last(string_split(output, chr(10))) FROM model_outputs WHERE conv_id % 9 = 0),
pe AS (SELECT window_ref, conv_id, CASE conv_id % 9 WHEN 1 THEN 'application' WHEN 2 THEN 'duplicate_basis' WHEN 3 THEN CASE WHEN length(output) > 65536 THEN 'too_long' ELSE 'markers' END ELSE 'duplicate_target' END AS error FROM model_outputs WHERE conv_id % 9 IN (1, 2, 3, 7)),
offered AS (SELECT concat('win-', CAST(c.conv_id AS VARCHAR)) AS window_ref, r.version_ref, r.application_scope FROM (SELECT DISTINCT conv_id, scope_kind, relationship_ref FROM episodes) c JOIN recollections r ON r.home = c.conv_id AND r.scope_kind = c.scope_kind AND r.relationship_ref = c.relationship_ref WHERE r.status = 'active')"""
_C = sql_with(*_EV, extra=_TGT)


def parsed(t: Tables):
    return ch.parse_outputs(t("model_outputs"))


@query("c07_parse_outputs", _C + """SELECT window_ref, change_no, target, application, operation, text, basis, NULL AS error FROM pc UNION ALL SELECT window_ref, NULL, NULL, NULL, NULL, NULL, NULL, error FROM pe""")
def _(t: Tables):
    return parsed(t).select("window_ref", F.col("change_no").cast("bigint").alias("change_no"), "target", "application", "operation", "text", F.array_join("basis_refs", ",").alias("basis"), "error")


def offered(t: Tables):
    e = t("episodes").select("conv_id", "scope_kind", "relationship_ref").distinct().withColumn("home", F.col("conv_id"))
    return e.join(t("recollections").filter("status = 'active'"), ["home", "scope_kind", "relationship_ref"]).select(
        F.concat(F.lit("win-"), "conv_id").alias("window_ref"), "version_ref", "application_scope")


@query("c07_offered_audit", _C + """SELECT window_ref, change_no, 'target' AS what, target AS ref FROM pc WHERE target NOT LIKE 'NEW%' AND (window_ref, target) NOT IN (SELECT (window_ref, version_ref) FROM offered)
UNION ALL SELECT window_ref, change_no, 'basis', basis FROM pc WHERE operation = 'KEEP'""")
def _(t: Tables):
    changes = parsed(t)
    new = t("model_outputs").select("window_ref", F.explode(F.array(F.lit("NEW_RECOLLECTION"), F.lit("NEW_DISPOSITION"))).alias("ref"))
    targets = offered(t).select("window_ref", F.col("version_ref").alias("ref")).unionByName(new)
    # windows that end in KEEP are offered no basis
    basis = members(t).filter("origin = 'current'").select("window_ref", F.col("episode_ref").alias("ref")).join(
        changes.filter("operation = 'KEEP'").select("window_ref").distinct(), "window_ref", "left_anti")
    return ch.offered_audit(changes, targets, basis).withColumn("change_no", F.col("change_no").cast("bigint"))


def window_heads(t: Tables):
    o = t("episodes").select("tenant_ref", "scope_kind", "agent_ref", "relationship_ref", "conv_id").distinct()
    return o.withColumn("window_ref", F.concat(F.lit("win-"), "conv_id")).withColumn("job_ref", F.concat(F.lit("job-"), "conv_id"))


def validated(t: Tables):
    # outputs are parsed once; the checks read them several times
    changes = cut_lineage(parsed(t))
    r = rows(t)
    flags = cut_lineage(ev.episode_flags(r))
    b = changes.filter("error IS NULL").select("window_ref", "change_no", F.explode("basis_refs").alias("ref"))
    m = members(t)
    none = members(t).filter("origin = 'none'")
    targets = none.select("window_ref", F.col("episode_ref").alias("version_ref"), F.lit("agent").alias("target_kind"), F.lit(True).alias("same_owner"))
    feedback = none.select("window_ref", F.col("episode_ref").alias("version_ref"), F.col("episode_ref").alias("ref"), F.lit("episode").alias("what"), "episode_ref")
    return ch.validate_changes(changes, window_heads(t), m, offered(t), targets, feedback,
                               ev.formation_basis(b, m, flags, r, t("window_outcomes")), ev.adaptation_basis(b, m, flags))


_VALID = """vd AS (SELECT p.*, conv_id % 9 IN (0, 8) OR (p.window_ref, p.target, lower(p.application)) IN (SELECT (window_ref, version_ref, application_scope) FROM offered) AS valid FROM pc p)"""


@query("c08_validate_changes", sql_with(*_EV, extra=_TGT + "," + _VALID) + "SELECT window_ref, change_no, target, operation, valid, bool_and(valid) OVER (PARTITION BY window_ref) AS window_valid FROM vd")
def _(t: Tables):
    return validated(t).select("window_ref", F.col("change_no").cast("bigint").alias("change_no"), "target", "operation", "valid", "window_valid")


# --- feedback windows ------------------------------------------------------------------------------
def twice(df):
    """Rows of windows, also for the feedback windows of the same conversations."""
    return df.unionByName(df.withColumn("window_ref", F.concat(F.lit("fb-"), F.substring("window_ref", 5, 1 << 20))))


def offered_feedback(t: Tables, m, flags):
    """(targets, feedback): dispositions that a window may change, and the references that each of them offers."""
    chain = cut_lineage(delivered_chain(t))
    current = m.filter("origin = 'current'").select("window_ref", "episode_ref")
    seen = current.join(chain, "episode_ref")
    free = feedback.open_feedback(chain, t("seed_basis"))
    direct = current.join(flags.filter("user_situation").select("episode_ref"), "episode_ref")
    owner = ["tenant_ref", "scope_kind", "agent_ref", "relationship_ref"]
    active = t("dispositions").filter("status = 'active'").select(*owner, "version_ref", "home")
    heads = all_windows(t).withColumn("home", F.col("conv_id"))
    # shown in the window, or offered to a window in which the user asks for something
    asked = heads.join(direct.select("window_ref").distinct(), "window_ref").select("window_ref", "home").join(active, "home").select("window_ref", "version_ref")
    named = seen.select("window_ref", "version_ref").unionByName(asked).distinct()
    own = heads.select("window_ref", F.struct(*owner).alias("own"))
    targets = named.join(active.select("version_ref", F.col("scope_kind").alias("target_kind"), F.struct(*owner).alias("owner")), "version_ref").join(own, "window_ref").select(
        "window_ref", "version_ref", "target_kind", (F.col("own") == F.col("owner")).alias("same_owner"))
    targets = cut_lineage(targets)
    row = lambda df, ref, what: df.select("window_ref", "version_ref", F.col(ref).alias("ref"), F.lit(what).alias("what"), "episode_ref").distinct()
    answered = feedback.attribute_outcomes(free, t("outcome_heads"), t("outcome_deliveries"))
    anchors = t("seed_basis").filter("role IN ('formation', 'revision')").select("version_ref", "episode_ref")
    rows_ = (
        row(current.join(free, "episode_ref"), "episode_ref", "episode").unionByName(row(current.join(answered, "episode_ref"), "outcome_ref", "outcome"))
        .unionByName(row(targets.join(anchors, "version_ref"), "episode_ref", "anchor"))
        .unionByName(row(targets.filter("same_owner").join(direct, "window_ref"), "episode_ref", "direct")))
    return targets, cut_lineage(rows_)


def all_windows(t: Tables):
    """Windows in the order of their owners: by conversation, feedback after what it says."""
    heads = window_heads(t)
    fb = heads.withColumn("window_ref", F.concat(F.lit("fb-"), "conv_id")).withColumn("job_ref", F.concat(F.lit("feedback-job-"), "conv_id"))
    return heads.withColumn("place", F.col("conv_id") * 2).unionByName(fb.withColumn("place", F.col("conv_id") * 2 + 1))


def feedback_judge(t: Tables, changes):
    """A function that validates some of the changes once some versions are no longer active."""
    r = rows(t)
    flags = cut_lineage(ev.episode_flags(r))
    m = cut_lineage(twice(members(t)))
    outcomes = twice(t("window_outcomes"))
    targets, offers = offered_feedback(t, m, flags)
    known = cut_lineage(twice(offered(t)))
    b = changes.filter("error IS NULL").select("window_ref", "change_no", F.explode("basis_refs").alias("ref"))
    forms, adapts = cut_lineage(ev.formation_basis(b, m, flags, r, outcomes)), cut_lineage(ev.adaptation_basis(b, m, flags))
    heads = all_windows(t)

    def judge(some, dead):
        left = lambda df: df.join(dead, "version_ref", "left_anti")
        return ch.validate_changes(some, heads, m, left(known), left(targets), left(offers), forms, adapts)

    return judge


def all_changes(t: Tables):
    both = t("model_outputs").select("window_ref", "output").unionByName(t("feedback_outputs").select("window_ref", "output"))
    return cut_lineage(ch.parse_outputs(both))


_FEEDBACK = ("contexts", "context_items", "delivery_heads", "delivery_refs", "outcome_deliveries", "seed_basis", "feedback_changes")
_FB = """chain AS (SELECT DISTINCT l.episode_ref, s.version_ref, d.receipt_ref
 FROM contexts c JOIN context_items i ON i.context_ref = c.context_ref AND i.item_kind = 'disposition' JOIN delivery_heads d ON d.context_ref = c.context_ref AND d.run_ref = c.run_ref
 JOIN delivery_refs r ON r.receipt_ref = d.receipt_ref AND r.memory_ref = i.memory_ref JOIN dispositions s ON s.version_ref = i.memory_ref AND s.status = 'active'
 JOIN links l ON l.run_ref = c.run_ref AND l.session_ref = c.session_ref AND l.role = 'situation' AND l.source_ref = i.query_source_ref),
free AS (SELECT * FROM chain c WHERE NOT EXISTS (SELECT 1 FROM seed_basis b WHERE b.version_ref = c.version_ref AND b.episode_ref = c.episode_ref AND b.role IN ('reenactment', 'inhibition'))),
answered AS (SELECT DISTINCT f.version_ref, o.outcome_ref, o.episode_ref FROM free f JOIN outcome_heads o ON o.episode_ref = f.episode_ref AND o.actor_kind <> 'agent' JOIN outcome_deliveries r ON r.outcome_ref = o.outcome_ref AND r.receipt_ref = f.receipt_ref),
here AS (SELECT concat('fb-', substr(window_ref, 5)) AS window_ref, episode_ref, origin FROM window_members),
fq AS (SELECT f.*, d.scope_kind AS target_kind, EXISTS (SELECT 1 FROM here h JOIN chain c USING (episode_ref) WHERE h.window_ref = f.window_ref AND h.origin = 'current' AND c.version_ref = f.target) AS shown,
  EXISTS (SELECT 1 FROM here h JOIN er ON er.episode_ref = h.episode_ref WHERE h.window_ref = f.window_ref AND h.origin = 'current' AND er.role = 'situation' AND er.actor_kind = 'user') AS asked,
  list_filter([b1, b2, b3], lambda x : x <> '') AS refs
 FROM feedback_changes f JOIN dispositions d ON d.version_ref = f.target),
fr AS (SELECT q.window_ref, q.change_no, q.target, q.ref,
  EXISTS (SELECT 1 FROM here h JOIN free x USING (episode_ref) WHERE h.window_ref = q.window_ref AND h.origin = 'current' AND x.version_ref = q.target AND x.episode_ref = q.ref) AS fe,
  EXISTS (SELECT 1 FROM seed_basis b WHERE b.version_ref = q.target AND b.episode_ref = q.ref AND b.role = 'formation') AS fa,
  (SELECT min(a.episode_ref) FROM answered a JOIN here h USING (episode_ref) WHERE h.window_ref = q.window_ref AND h.origin = 'current' AND a.version_ref = q.target AND a.outcome_ref = q.ref) AS oe,
  EXISTS (SELECT 1 FROM here h WHERE h.window_ref = q.window_ref AND h.origin <> 'revision_anchor' AND h.episode_ref = q.ref) AS known,
  EXISTS (SELECT 1 FROM here h JOIN er USING (episode_ref) WHERE h.window_ref = q.window_ref AND h.origin = 'current' AND h.episode_ref = q.ref AND er.role = 'situation' AND er.actor_kind = 'user') AS direct
 FROM (SELECT *, unnest(refs) AS ref FROM fq) q),
fs AS (SELECT window_ref, change_no, count(*) AS n, bool_and(fe) AS all_fe, bool_and(fe OR oe IS NOT NULL) AS plain, bool_and(fe OR fa OR oe IS NOT NULL) AS anchored, bool_or(direct) AS direct, bool_and(known) AS known, bool_and(known OR fa) AS known_fa,
  coalesce(list_sort(list(DISTINCT ref) FILTER (fe)), []) AS cited, coalesce(list_sort(list(DISTINCT oe) FILTER (oe IS NOT NULL AND NOT fe AND NOT fa)), []) AS replied FROM fr GROUP BY 1, 2),
fv AS (SELECT q.window_ref, q.conv_id, q.change_no, q.target, q.operation, q.text, q.refs, (q.shown OR q.asked) AND q.application = CASE q.target_kind WHEN 'agent' THEN 'SELF' ELSE 'RELATION' END AND CASE q.operation
  WHEN 'REENACT' THEN s.all_fe WHEN 'INHIBIT' THEN s.plain AND len(s.cited) > 0 AND s.cited = s.replied WHEN 'TEXT' THEN s.anchored AND len(s.cited) > 0 AND s.cited = s.replied
  ELSE s.n = 1 AND s.direct AND CASE WHEN EXISTS (SELECT 1 FROM here h JOIN free x USING (episode_ref) WHERE h.window_ref = q.window_ref AND h.origin = 'current' AND x.version_ref = q.target) THEN s.known_fa ELSE s.known END END AS valid
 FROM fq q JOIN fs s USING (window_ref, change_no))"""
_F = sql_with(*_EV, *_FEEDBACK, extra=_ROWS + "," + _FB)


@query("c08_validate_feedback", _F + "SELECT window_ref, change_no, target, operation, valid, bool_and(valid) OVER (PARTITION BY window_ref) AS window_valid FROM fv")
def _(t: Tables):
    changes = cut_lineage(ch.parse_outputs(t("feedback_outputs")))
    none = t("dispositions").select("version_ref").filter("false")
    return feedback_judge(t, changes)(changes, none).select("window_ref", F.col("change_no").cast("bigint").alias("change_no"), "target", "operation", "valid", "window_valid")


def feedback_state(t: Tables):
    r = rows(t)
    flags = cut_lineage(ev.episode_flags(r))
    m = cut_lineage(twice(members(t)))
    targets, offers = offered_feedback(t, m, flags)
    named = targets.filter("window_ref LIKE 'fb-%'").select("window_ref", "version_ref").join(
        t("dispositions").select("tenant_ref", "scope_kind", "agent_ref", "relationship_ref", "root_ref", "version_ref", "version_number", "text"), "version_ref")
    current = m.filter("origin = 'current'").select("window_ref", "episode_ref")
    receipts = current.join(feedback.open_feedback(delivered_chain(t), t("seed_basis")), "episode_ref").select("window_ref", "version_ref", "episode_ref", "receipt_ref").distinct()
    return windows.feedback_state_hash(named, offers, t("seed_basis"), receipts)


_FSTATE = _FB + f""",
tg AS (SELECT DISTINCT h.window_ref, c.version_ref FROM here h JOIN chain c USING (episode_ref) WHERE h.origin = 'current'
 UNION SELECT DISTINCT h.window_ref, d.version_ref FROM here h JOIN er USING (episode_ref) JOIN dispositions d ON concat('fb-', CAST(d.home AS VARCHAR)) = h.window_ref AND d.status = 'active' WHERE h.origin = 'current' AND er.role = 'situation' AND er.actor_kind = 'user'),
di AS (SELECT DISTINCT h.window_ref, h.episode_ref FROM here h JOIN er USING (episode_ref) WHERE h.origin = 'current' AND er.role = 'situation' AND er.actor_kind = 'user'),
fo AS (SELECT DISTINCT h.window_ref, x.version_ref, x.episode_ref, x.receipt_ref FROM here h JOIN free x USING (episode_ref) WHERE h.origin = 'current'),
pt AS (SELECT g.window_ref, g.version_ref, 0 AS part, '' AS one, '' AS two, [d.scope_kind, d.tenant_ref, d.agent_ref, d.relationship_ref, d.root_ref, d.version_ref, CAST(d.version_number AS VARCHAR), d.text] AS f FROM tg g JOIN dispositions d USING (version_ref)
 UNION ALL SELECT window_ref, version_ref, 2 * k, '', '', [['direct-episodes', 'outcomes', 'anchors', 'basis-state'][k]] FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM tg)
 UNION ALL SELECT DISTINCT window_ref, version_ref, 1, episode_ref, '', [episode_ref] FROM fo
 UNION ALL SELECT g.window_ref, g.version_ref, 3, i.episode_ref, '', [i.episode_ref] FROM tg g JOIN di i USING (window_ref)
 UNION ALL SELECT DISTINCT h.window_ref, a.version_ref, 5, a.outcome_ref, '', [a.outcome_ref, a.episode_ref] FROM here h JOIN answered a USING (episode_ref) WHERE h.origin = 'current'
 UNION ALL SELECT g.window_ref, g.version_ref, 7, b.episode_ref, '', [b.episode_ref] FROM tg g JOIN (SELECT DISTINCT version_ref, episode_ref FROM seed_basis WHERE role = 'formation') b USING (version_ref)
 UNION ALL SELECT g.window_ref, g.version_ref, 9, concat('episode', chr(0), b.role, chr(0), b.episode_ref), '', [concat('episode', chr(0), b.role, chr(0), b.episode_ref)] FROM tg g JOIN (SELECT DISTINCT version_ref, role, episode_ref FROM seed_basis) b USING (version_ref)
 UNION ALL SELECT DISTINCT window_ref, version_ref, 10, episode_ref, '', ['receipts', episode_ref] FROM fo
 UNION ALL SELECT window_ref, version_ref, 10, episode_ref, receipt_ref, [receipt_ref] FROM fo)"""


@query("a15_feedback_state_hash", sql_with(*_EV, *_FEEDBACK, extra=_ROWS + "," + _FSTATE) + f"""SELECT window_ref, sha256({field("'feedback-state.v1'")} || unhex(string_agg({list_hex('f')}, '' ORDER BY version_ref, part, one, two))) AS state_hash FROM pt GROUP BY 1""")
def _(t: Tables):
    return feedback_state(t)


# every change of every owner in order; the walk takes one change a step and keeps what an owner has replaced and now holds
_WALK = _TGT + "," + _VALID + "," + _FB + f""",
ac AS (SELECT window_ref, conv_id, conv_id * 2 AS place, change_no, target, application, operation, text, basis AS cites, [basis] AS refs, valid FROM vd
 UNION ALL SELECT window_ref, conv_id, conv_id * 2 + 1, change_no, target, '', operation, text, list_aggregate(refs, 'string_agg', ','), refs, valid FROM fv),
vs AS (SELECT 'recollection' AS kind, tenant_ref, scope_kind, agent_ref, relationship_ref, version_ref, root_ref, version_number, text, application_scope FROM recollections WHERE status = 'active'
 UNION ALL SELECT 'disposition', tenant_ref, scope_kind, agent_ref, relationship_ref, version_ref, root_ref, version_number, text, application_scope FROM dispositions WHERE status = 'active'),
oc AS (SELECT a.*, o.tenant_ref, o.scope_kind, o.agent_ref, o.relationship_ref, v.root_ref, v.version_number, v.text AS old_text,
  CASE a.target WHEN 'NEW_RECOLLECTION' THEN 'recollection' WHEN 'NEW_DISPOSITION' THEN 'disposition' ELSE v.kind END AS kind,
  CASE a.target WHEN 'NEW_RECOLLECTION' THEN lower(a.application) WHEN 'NEW_DISPOSITION' THEN CASE a.application WHEN 'SELF' THEN 'self' ELSE 'relation' END ELSE v.application_scope END AS scope,
  bool_and(a.valid) OVER (PARTITION BY a.window_ref) AS fits, list(a.target) OVER (PARTITION BY a.window_ref) AS all_targets,
  row_number() OVER (PARTITION BY o.tenant_ref, o.scope_kind, o.agent_ref, o.relationship_ref ORDER BY a.place, a.change_no) AS n, a.change_no = 0 AS starts
 FROM ac a JOIN (SELECT DISTINCT conv_id, tenant_ref, scope_kind, agent_ref, relationship_ref FROM episodes) o USING (conv_id) LEFT JOIN vs v ON v.version_ref = a.target),
held AS (SELECT tenant_ref, scope_kind, agent_ref, relationship_ref, list(concat(kind, '|', application_scope, '|', text, '|', version_ref)) AS live FROM vs WHERE text IN (SELECT text FROM ac) GROUP BY ALL),
walk AS (SELECT o.tenant_ref, o.scope_kind, o.agent_ref, o.relationship_ref, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS dead, coalesce(any_value(h.live), CAST([] AS VARCHAR[])) AS live, false AS ok, '' AS made, false AS applied
 FROM oc o LEFT JOIN held h ON h.tenant_ref = o.tenant_ref AND h.scope_kind = o.scope_kind AND h.agent_ref = o.agent_ref AND h.relationship_ref = o.relationship_ref GROUP BY 1, 2, 3, 4
 UNION ALL
 SELECT tenant_ref, scope_kind, agent_ref, relationship_ref, n, CASE WHEN writes AND target NOT LIKE 'NEW%' THEN list_append(dead, target) ELSE dead END,
  CASE WHEN writes THEN list_append(list_filter(live, lambda x : NOT ends_with(x, '|' || target)), concat(kind, '|', scope, '|', text, '|', new_ref)) ELSE live END, ok, CASE WHEN writes THEN new_ref ELSE '' END, ok
 FROM (SELECT *, ok AND operation IN ('TEXT', 'ADAPT') AND text <> '' AND text IS DISTINCT FROM old_text AND len(list_filter(live, lambda x : starts_with(x, concat(kind, '|', scope, '|', text, '|')) AND NOT ends_with(x, '|' || target))) = 0 AS writes
  FROM (SELECT o.*, w.dead, w.live, CASE WHEN o.starts THEN o.fits AND NOT list_has_any(w.dead, o.all_targets) ELSE w.ok END AS ok,
   CASE o.target WHEN 'NEW_RECOLLECTION' THEN 'recollection_' || substr({hash_blob(field("'recollection-form.v1'"), *[field("o." + x) for x in ("scope_kind", "tenant_ref", "agent_ref", "relationship_ref")], field("concat('job-', CAST(o.conv_id AS VARCHAR))"), field("o.scope"), field("o.text"), field("o.cites"))}, 1, 32) || '@1'
    WHEN 'NEW_DISPOSITION' THEN 'seed_' || substr({hash_blob(field("'seed-form.v1'"), *[field("o." + x) for x in ("scope_kind", "tenant_ref", "agent_ref", "relationship_ref")], field("concat('job-', CAST(o.conv_id AS VARCHAR))"), field("o.text"), field("o.cites"))}, 1, 32) || '@1'
    ELSE o.root_ref || '@' || (o.version_number + 1) END AS new_ref
   FROM walk w JOIN oc o ON o.tenant_ref = w.tenant_ref AND o.scope_kind = w.scope_kind AND o.agent_ref = w.agent_ref AND o.relationship_ref = w.relationship_ref AND o.n = w.n + 1))),
dn AS (SELECT o.*, w.made, w.applied FROM walk w JOIN oc o USING (tenant_ref, scope_kind, agent_ref, relationship_ref, n))"""
_O = sql_with(*_EV, *_FEEDBACK, "recollection_basis", extra=_ROWS + "," + _WALK).replace("WITH ", "WITH RECURSIVE ", 1)


def applied(t: Tables):
    from .selection import basis, versions

    changes = all_changes(t)
    return ch.apply_in_order(changes, all_windows(t).drop("conv_id"), feedback_judge(t, changes), versions(t), basis(t), t("episodes"), t("outcome_heads").select("outcome_ref"))


@query("c09_apply_changes", _O + "SELECT kind, made AS version_ref, text, scope AS application_scope FROM dn WHERE made <> ''")
def _(t: Tables):
    return applied(t)["versions"].select("kind", "version_ref", "text", "application_scope")


@query("c09_basis_rows", _O + """, bs AS (SELECT made AS version_ref, CASE WHEN target LIKE 'NEW%' THEN 'formation' ELSE 'revision' END AS role, unnest(refs) AS ref FROM dn WHERE made <> ''
 UNION ALL SELECT target, 'support', unnest(refs) FROM dn WHERE applied AND operation = 'KEEP' UNION ALL SELECT target, 'inhibition', unnest(refs) FROM dn WHERE applied AND operation = 'INHIBIT'),
 old AS (SELECT version_ref, episode_ref, role FROM recollection_basis UNION SELECT version_ref, episode_ref, role FROM seed_basis),
 re AS (SELECT d.target, r.ref FROM (SELECT *, unnest(refs) AS ref FROM dn WHERE applied AND operation = 'REENACT') d JOIN (SELECT target, window_ref, change_no, unnest(refs) AS ref FROM dn WHERE applied AND operation = 'REENACT') r USING (target, window_ref, change_no, ref)
  WHERE NOT EXISTS (SELECT 1 FROM old b WHERE b.version_ref = d.target AND list_contains(d.refs, b.episode_ref)))
SELECT version_ref, role, ref FROM bs b WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.version_ref = b.version_ref AND o.episode_ref = b.ref AND o.role = b.role)
UNION SELECT target, 'reenactment', ref FROM re""")
def _(t: Tables):
    return applied(t)["basis"].select("version_ref", "role", "ref")


@query("c09_index_operations", _O + "SELECT kind, made AS document_ref, 'UPSERT' AS action FROM dn WHERE made <> '' UNION ALL SELECT kind, target, 'DELETE' FROM dn WHERE made <> '' AND target NOT LIKE 'NEW%'")
def _(t: Tables):
    return applied(t)["operations"].drop("tenant_ref")


# --- index -----------------------------------------------------------------------------------------
_DOCS = """docs AS (SELECT 0 AS kind_order, 'EPISODE' AS kind, t.episode_ref AS ref, t.tenant_ref, t.agent_ref, t.relationship_ref, concat('SITUATION [user]', chr(10), t.user_text, chr(10), 'AGENT_ACT [agent]', chr(10), t.agent_text, CASE WHEN r.reply_text IS NULL THEN '' ELSE concat(chr(10), 'OUTCOME [user]', chr(10), r.reply_text) END) AS text FROM turns t LEFT JOIN replies r USING (episode_ref)
 UNION ALL SELECT 1, 'RECOLLECTION', version_ref, tenant_ref, agent_ref, relationship_ref, text FROM recollections WHERE status = 'active'
 UNION ALL SELECT 2, 'DISPOSITION', version_ref, tenant_ref, agent_ref, relationship_ref, text FROM dispositions WHERE status = 'active')"""
_D = sql_with("turns", "replies", "recollections", "dispositions", extra=_DOCS)


def documents(t: Tables):
    return index_log.index_documents(rendered_episodes(t), t("recollections"), t("dispositions"))


@query("u01_index_documents", _D + "SELECT * FROM docs")
def _(t: Tables):
    return documents(t)


@query("t15_keyset_page", _D + """SELECT kind_order, ref, (SELECT count(*) FROM docs WHERE kind_order > 0 OR ref > 'episode_4') > 150 AS has_more FROM docs WHERE kind_order > 0 OR ref > 'episode_4' ORDER BY kind_order, ref LIMIT 150""")
def _(t: Tables):
    return fusion.keyset_page(documents(t).select("kind_order", "ref"), 0, "episode_4", 150)


_LOG = """lg AS (SELECT d.kind, d.ref, x.action, x.seq FROM docs d JOIN (SELECT 0 AS z, 'UPSERT' AS action, 1 AS seq) x ON x.z = 0 WHERE length(d.ref) % 2 = 0
 UNION ALL SELECT kind, ref, 'DELETE', 2 FROM docs WHERE length(text) % 3 = 0 UNION ALL SELECT kind, ref, 'UPSERT', 3 FROM docs WHERE length(text) % 9 = 0)"""


@query("x05_apply_index_log", sql_with("turns", "replies", "recollections", "dispositions", extra=_DOCS) + """SELECT kind, ref, CASE WHEN length(text) % 9 = 0 OR (length(ref) % 2 = 0 AND length(text) % 3 <> 0) THEN text ELSE 'old' END AS text FROM docs
WHERE length(text) % 9 = 0 OR (length(text) % 3 <> 0 AND (length(ref) % 2 = 0 OR length(text) % 5 = 1))""")
def _(t: Tables):
    d = documents(t)
    op = lambda df, action, seq: df.select("kind", "ref", F.lit(action).alias("action"), F.lit(seq).alias("sequence"))
    log = op(d.filter("length(ref) % 2 = 0"), "UPSERT", 1).unionByName(op(d.filter("length(text) % 3 = 0"), "DELETE", 2)).unionByName(
        op(d.filter("length(text) % 9 = 0"), "UPSERT", 3)).unionByName(op(d.withColumn("kind", F.lit("NOTE")), "UPSERT", 4))
    stale = d.filter("length(text) % 5 = 1").select("kind", "ref", F.lit("old").alias("text"))
    return index_log.apply_index_log(stale, log, d)


@query("x05_index_table", sql_with("turns", "replies", "recollections", "dispositions", extra=_DOCS + "," + _LOG) + """SELECT kind, ref, text FROM docs JOIN (SELECT kind, ref, arg_max(action, seq) AS action FROM lg GROUP BY ALL) USING (kind, ref) WHERE action = 'UPSERT'""")
def _(t: Tables):
    d = cut_lineage(documents(t))
    index = index_table.IndexTable(t.spark, f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}", buckets=16)
    # three batches; the second one comes twice, and number 2 is lost on the way with nothing in it
    for number, seq in ((0, 1), (1, 2), (1, 2), (3, 3)):
        index.apply(index_ops(d).filter(F.col("sequence") == seq), number, d)
    return index.read()


def index_ops(d):
    op = lambda df, action, seq: df.select("kind", "ref", F.lit(action).alias("action"), F.lit(seq).alias("sequence"))
    return op(d.filter("length(ref) % 2 = 0"), "UPSERT", 1).unionByName(op(d.filter("length(text) % 3 = 0"), "DELETE", 2)).unionByName(op(d.filter("length(text) % 9 = 0"), "UPSERT", 3))


# documents change while the index is rebuilt: the snapshot has their first text, later operations the present one
_TOKENS = "string_split(trim(regexp_replace({}, '\\s+', ' ', 'g')), ' ')"
_RB = _DOCS + "," + _LOG + f""",
en AS (SELECT d.kind, d.ref, CASE WHEN x.action = 'UPSERT' THEN d.text WHEN x.action IS NULL THEN concat('first ', d.text) END AS text FROM docs d LEFT JOIN (SELECT kind, ref, arg_max(action, seq) AS action FROM lg WHERE seq > 1 GROUP BY ALL) x USING (kind, ref)),
tk AS (SELECT kind, ref, {_TOKENS.format('text')} AS tok FROM en WHERE text IS NOT NULL)"""


@query("x06_rebuild_under_changes", sql_with("turns", "replies", "recollections", "dispositions", extra=_RB) + """SELECT kind, ref, CAST(i AS BIGINT) AS chunk, array_to_string(tok[i * 188 + 1 : i * 188 + 220], ' ') AS text
 FROM (SELECT kind, ref, tok, unnest(range(0, CAST(greatest(ceil((len(tok) - 220) / 188.0), 0) AS BIGINT) + 1)) AS i FROM tk)""")
def _(t: Tables):
    d = cut_lineage(documents(t).select("kind", "ref", "text"))
    first = d.withColumn("text", F.concat(F.lit("first "), "text"))
    return index_log.rebuild_under_changes(first, index_ops(d), d, position=1)


@query("x06_rebuild_index", _D + "SELECT kind, ref, text AS semantic_text, sha256(text) AS semantic_sha FROM docs")
def _(t: Tables):
    return index_log.rebuild_index(documents(t)).select("kind", "ref", "semantic_text", "semantic_sha")


# --- evidence snippets -------------------------------------------------------------------------------
_SN = """sn AS (SELECT concat('q-', run_ref) AS question_ref, conv_id, 0 AS pos, 'user' AS role, CASE conv_id % 4 WHEN 0 THEN user_text WHEN 1 THEN substr(user_text, 1, instr(user_text || ' ', ' ') - 1) WHEN 2 THEN concat(user_text, ' absent') ELSE user_text END AS text FROM turns
 UNION ALL SELECT concat('q-', run_ref), conv_id, 1, 'assistant', agent_text FROM turns WHERE conv_id % 8 <> 1)"""


@query("j12_snippet_alignment", sql_with("turns", extra=_SN + """,
n AS (SELECT conv_id, user_turn AS idx, trim(regexp_replace(user_text, '\\s+', ' ', 'g')) AS u, trim(regexp_replace(agent_text, '\\s+', ' ', 'g')) AS a FROM turns),
h AS (SELECT s.question_ref, n.idx, (SELECT bool_or(contains(' ' || n.a || ' ', ' ' || trim(regexp_replace(r.text, '\\s+', ' ', 'g')) || ' ')) FROM sn r WHERE r.question_ref = s.question_ref AND r.pos = 1) AS backed
  FROM sn s JOIN n ON n.conv_id = s.conv_id AND contains(' ' || n.u || ' ', ' ' || trim(regexp_replace(s.text, '\\s+', ' ', 'g')) || ' ') WHERE s.pos = 0),
k AS (SELECT question_ref, CASE WHEN count_if(backed) > 0 THEN count_if(backed) ELSE count(*) END AS c FROM h GROUP BY 1)""") + """
SELECT q.question_ref, CASE WHEN coalesce(c, 0) = 0 THEN 'unmatched' WHEN c = 1 THEN 'matched' ELSE 'ambiguous' END AS status, least(coalesce(c, 0), 2) AS matches FROM (SELECT DISTINCT question_ref FROM sn) q LEFT JOIN k USING (question_ref)""")
def _(t: Tables):
    turns = t("turns")
    c = F.col("conv_id") % 4
    word = F.substring_index("user_text", " ", 1)
    user = turns.select(F.concat(F.lit("q-"), "run_ref").alias("question_ref"), "conv_id", F.lit(0).alias("pos"), F.lit("user").alias("role"),
                        F.when(c == 1, word).when(c == 2, F.concat("user_text", F.lit(" absent"))).otherwise(F.col("user_text")).alias("text"))
    agent = turns.filter("conv_id % 8 <> 1").select(F.concat(F.lit("q-"), "run_ref").alias("question_ref"), "conv_id", F.lit(1).alias("pos"), F.lit("assistant").alias("role"), F.col("agent_text").alias("text"))
    return ev.snippet_alignment(user.unionByName(agent), turns.select("conv_id", F.col("user_turn").alias("idx"), "user_text", "agent_text")).withColumn("matches", F.col("matches").cast("bigint"))
