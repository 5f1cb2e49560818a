"""Views that give the driver's tables the shape of memory data.

Each view is one SQL text that means the same in Spark and in DuckDB, so that a query and its check
start from equal inputs. ``{name}`` stands for another view or a driver table, ``EACH(a, b)`` for one row per listed value.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from .session import cut_lineage

DRIVER_TABLES = frozenset(
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations".split())

# A conversation belongs to the agent itself when conv_id % 7 = 3, else to one of 20 relationships.
# Tenants hold 100 conversations each, so that owners grow with the data.
_SCOPE = """concat('t', CAST(CAST(floor({c} / 100) AS BIGINT) AS STRING)) AS tenant_ref,
    CASE WHEN {c} % 7 = 3 THEN 'agent' ELSE 'relationship' END AS scope_kind,
    'agent' AS agent_ref,
    CASE WHEN {c} % 7 = 3 THEN '' ELSE concat('rel-', CAST({c} % 20 AS STRING)) END AS relationship_ref"""


def _owner(c: str) -> str:
    return _SCOPE.replace("{c}", c)


def _scope(c: str) -> str:
    return _owner(c) + f",\n    concat('conv-', CAST({c} AS STRING)) AS session_ref"


_RUN = "concat('run-', CAST({c} AS STRING), '-', CAST({t} AS STRING))"
_SRC = "concat('src-', CAST({c} AS STRING), '-', CAST({t} AS STRING))"
_EP = "concat('episode_', CAST({c} AS STRING), '_', CAST({t} AS STRING))"


def _ref(template: str, c: str, t: str) -> str:
    return template.replace("{c}", c).replace("{t}", t)


_SCOPE_COLS = "tenant_ref, scope_kind, agent_ref, relationship_ref, session_ref"
_OWNER_COLS = "tenant_ref, scope_kind, agent_ref, relationship_ref"

VIEWS: dict[str, str] = {
    # --- conversation messages -------------------------------------------------------------------
    "messages": f"""
SELECT conv_id, turn, role, text, {_scope('conv_id')},
    {_ref(_SRC, 'conv_id', 'turn')} AS source_ref,
    conv_id * 100000 + turn * 10 AS arrival
FROM {{conversations}}""",
    # a user message and the assistant message right after it
    "turns": f"""
SELECT u.conv_id, u.turn AS user_turn, u.text AS user_text, a.text AS agent_text,
    u.tenant_ref, u.scope_kind, u.agent_ref, u.relationship_ref, u.session_ref,
    {_ref(_RUN, 'u.conv_id', 'u.turn')} AS run_ref,
    {_ref(_RUN, 'u.conv_id', 'u.turn')} AS source_group_ref,
    {_ref(_EP, 'u.conv_id', 'u.turn')} AS episode_ref,
    u.source_ref AS user_source, a.source_ref AS agent_source, u.arrival
FROM {{messages}} u JOIN {{messages}} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
    # the message that answers an episode: the next user message
    "replies": """
SELECT t.*, n.source_ref AS reply_source, n.text AS reply_text, n.arrival AS reply_arrival
FROM {turns} t JOIN {messages} n ON n.conv_id = t.conv_id AND n.turn = t.user_turn + 2
WHERE n.role = 'user'""",
    "sources": f"""
SELECT {_SCOPE_COLS}, source_ref,
    CASE WHEN role = 'assistant' THEN 'agent' WHEN role = 'system' THEN 'system' ELSE 'user' END AS actor_kind,
    CASE WHEN role = 'assistant' THEN 'agent' ELSE concat(role, '-', CAST(conv_id % 20 AS STRING)) END AS actor_ref,
    text,
    CASE WHEN conv_id % 6 = 0 THEN concat('constitution-', CAST(turn % 3 AS STRING)) ELSE '' END AS constitution_ref,
    CASE WHEN conv_id % 6 = 0 THEN concat('Rule ', CAST(turn % 3 AS STRING)) ELSE '' END AS constitution_text,
    arrival AS admission_order
FROM {{messages}}""",
    "links": f"""
SELECT {_SCOPE_COLS}, run_ref, source_group_ref, episode_ref, user_source AS source_ref, 'situation' AS role FROM {{turns}}
UNION ALL
SELECT {_SCOPE_COLS}, run_ref, source_group_ref, episode_ref, agent_source, 'agent_act' FROM {{turns}}
UNION ALL
SELECT {_SCOPE_COLS}, run_ref, source_group_ref, episode_ref, reply_source, 'outcome' FROM {{replies}}""",
    "episodes": f"""
SELECT {_SCOPE_COLS}, run_ref, source_group_ref, episode_ref, conv_id, user_turn, arrival FROM {{turns}}""",
    # --- intake requests with replays, conflicting keys, late links and invalid rows ----------------
    "requests": f"""
SELECT m.tenant_ref, m.scope_kind, m.agent_ref, m.relationship_ref, m.session_ref, m.source_ref,
    CASE WHEN m.role = 'assistant' THEN 'agent' WHEN m.role = 'system' THEN 'system' ELSE 'user' END AS actor_kind,
    CASE WHEN m.role = 'assistant' THEN 'agent' ELSE concat(m.role, '-', CAST(m.conv_id % 20 AS STRING)) END AS actor_ref,
    CASE WHEN m.copy = 2 THEN concat(m.text, '!') ELSE m.text END AS text,
    CASE WHEN m.conv_id % 6 = 0 THEN concat('constitution-', CAST(m.turn % 3 AS STRING)) ELSE '' END AS constitution_ref,
    CASE WHEN m.conv_id % 6 = 0 THEN concat('Rule ', CAST(m.turn % 3 AS STRING)) ELSE '' END AS constitution_text,
    CASE WHEN m.role = 'system' THEN ''
         ELSE {_ref(_RUN, 'm.conv_id', "(m.turn - CASE WHEN m.role = 'assistant' THEN 1 ELSE 0 END)")} END AS run_ref,
    CASE WHEN m.role = 'system' THEN ''
         ELSE {_ref(_RUN, 'm.conv_id', "(m.turn - CASE WHEN m.role = 'assistant' THEN 1 ELSE 0 END)")} END AS source_group_ref,
    CASE WHEN m.role = 'assistant' THEN 'agent_act' WHEN m.role = 'system' THEN '' ELSE 'situation' END AS role,
    concat('key-', CAST(m.conv_id AS STRING), '-', CAST(m.turn AS STRING)) AS idempotency_key,
    m.arrival * 10 + m.copy AS arrival
FROM (SELECT *, EACH(0, 1, 2) AS copy FROM {{messages}}) m
WHERE m.copy = 0 OR (m.copy = 1 AND m.conv_id % 10 = 0) OR (m.copy = 2 AND m.conv_id % 10 = 1)
UNION ALL
SELECT {_SCOPE_COLS}, concat('late-', run_ref), 'user', concat('user-', CAST(conv_id % 20 AS STRING)),
    CASE step WHEN 0 THEN 'Late situation.' WHEN 3 THEN 'Late situation.' ELSE 'Late situation again' END, '', '',
    CASE step WHEN 0 THEN run_ref ELSE '' END, CASE step WHEN 0 THEN source_group_ref ELSE '' END, CASE step WHEN 0 THEN 'situation' ELSE '' END,
    concat('late-key-', run_ref, CASE step WHEN 3 THEN '-other' ELSE '' END), (arrival + 10) * 10 + 5 + step
FROM (SELECT *, EACH(0, 1, 2, 3) AS step FROM {{turns}} WHERE conv_id % 10 IN (2, 3)) l
WHERE step <> 1 OR conv_id % 10 = 2""",
    # requests broken in one way each, chosen by conversation and turn
    "dirty_requests": """
SELECT tenant_ref,
    CASE WHEN arrival % 13 = 1 THEN 'group' ELSE scope_kind END AS scope_kind,
    CASE WHEN length(text) % 11 = 1 THEN '' ELSE agent_ref END AS agent_ref,
    CASE WHEN length(text) % 17 = 2 THEN '' ELSE relationship_ref END AS relationship_ref,
    session_ref,
    CASE WHEN length(text) % 13 = 3 THEN repeat(source_ref, 40) ELSE source_ref END AS source_ref,
    CASE WHEN length(text) % 19 = 4 THEN 'robot' ELSE actor_kind END AS actor_kind,
    CASE WHEN length(text) % 23 = 5 THEN 'someone' ELSE actor_ref END AS actor_ref,
    CASE WHEN length(text) % 29 = 6 THEN '' WHEN length(text) % 29 = 7 THEN repeat(text, 700) ELSE text END AS text,
    CASE WHEN length(text) % 31 = 8 THEN 'has space' ELSE constitution_ref END AS constitution_ref,
    CASE WHEN length(text) % 31 = 8 THEN 'Rule' WHEN length(text) % 37 = 9 THEN '' ELSE constitution_text END AS constitution_text,
    run_ref,
    CASE WHEN length(text) % 41 = 10 THEN '' ELSE source_group_ref END AS source_group_ref,
    CASE WHEN length(text) % 43 = 11 THEN 'comment' ELSE role END AS role,
    idempotency_key, arrival
FROM {requests}""",
    # links in arrival order, some of them late or repeated
    "link_log": f"""
SELECT {_SCOPE_COLS}, run_ref, source_group_ref, source_ref, role,
    CASE WHEN role = 'situation' THEN arrival WHEN role = 'agent_act' THEN arrival + 1 ELSE arrival + 2 END AS arrival
FROM (
  SELECT {_SCOPE_COLS}, run_ref, source_group_ref, user_source AS source_ref, 'situation' AS role, arrival FROM {{turns}}
  UNION ALL
  SELECT {_SCOPE_COLS}, run_ref, source_group_ref, agent_source, 'agent_act', arrival FROM {{turns}} WHERE conv_id % 8 <> 2
  UNION ALL
  SELECT {_SCOPE_COLS}, run_ref, source_group_ref, user_source, 'agent_act', arrival FROM {{turns}} WHERE conv_id % 8 = 2 AND user_turn < 3
  UNION ALL
  SELECT {_SCOPE_COLS}, run_ref, source_group_ref, reply_source, 'outcome', arrival FROM {{replies}}
) x
UNION ALL
SELECT {_SCOPE_COLS}, run_ref, source_group_ref, user_source, 'situation', arrival + 4 FROM {{turns}} WHERE conv_id % 5 = 0
UNION ALL
SELECT {_SCOPE_COLS}, run_ref, source_group_ref, reply_source, 'situation', arrival + 5 FROM {{replies}} WHERE conv_id % 5 = 1""",
    # --- learned memories: dealt to all conversations, so that a conversation has as many at any scale -----
    "homes": """
SELECT max(conv_id) + 1 AS n FROM {conversations}""",
    "memory_docs": f"""
SELECT d.doc_id, d.text, d.lang, d.source, d.home, {_owner('d.home')},
    CASE WHEN l.toxic = 1 THEN 'superseded' ELSE 'active' END AS status,
    1 + d.doc_id % 3 AS version_number,
    concat('job-', CAST(CAST(floor(d.doc_id / 20) AS BIGINT) AS STRING)) AS origin_job_ref
FROM (SELECT *, doc_id % (SELECT n FROM {{homes}}) AS home FROM {{documents}}) d LEFT JOIN {{labels}} l ON l.doc_id = d.doc_id""",
    "recollections": f"""
SELECT {_OWNER_COLS}, concat('recollection_', CAST(doc_id AS STRING)) AS root_ref,
    concat('recollection_', CAST(doc_id AS STRING), '@', CAST(version_number AS STRING)) AS version_ref,
    version_number, text, CASE doc_id % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'other' WHEN 2 THEN 'relation' ELSE 'situation' END AS application_scope,
    status, origin_job_ref, doc_id AS created_order, home
FROM {{memory_docs}} WHERE doc_id % 5 <> 0""",
    "dispositions": f"""
SELECT {_OWNER_COLS}, concat('seed_', CAST(doc_id AS STRING)) AS root_ref,
    concat('seed_', CAST(doc_id AS STRING), '@', CAST(version_number AS STRING)) AS version_ref,
    version_number, text, CASE WHEN scope_kind = 'agent' THEN 'self' ELSE 'relation' END AS application_scope,
    status, origin_job_ref, doc_id AS created_order, home
FROM {{memory_docs}} WHERE doc_id % 5 = 0""",
    "recollection_basis": """
SELECT r.tenant_ref, r.version_ref, e.episode_ref,
    CASE WHEN e.user_turn <= 1 THEN 'formation' ELSE 'support' END AS role
FROM {recollections} r JOIN {episodes} e ON e.conv_id = r.home""",
    "seed_basis": """
SELECT s.tenant_ref, s.version_ref, e.episode_ref,
    CASE WHEN e.user_turn <= 1 THEN 'formation' WHEN s.created_order % 10 = 0 THEN 'reenactment' ELSE 'inhibition' END AS role
FROM {dispositions} s JOIN {episodes} e ON e.conv_id = s.home
WHERE e.user_turn <= 1 OR s.created_order % 10 = 0 OR (s.created_order % 25 = 15 AND e.user_turn > 2)""",
    # --- selection requests, frozen contexts, deliveries, outcomes -----------------------------------
    "selects": f"""
SELECT {_SCOPE_COLS}, run_ref, user_source AS source_ref, user_text AS text, conv_id, user_turn, arrival,
    CASE WHEN conv_id % 6 = 0 THEN 'constitution-0' ELSE '' END AS constitution_ref,
    CASE WHEN conv_id % 6 = 0 THEN 'Rule 0' ELSE '' END AS constitution_text,
    CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 4096 END AS evidence_bytes
FROM {{turns}}""",
    "contexts": f"""
SELECT {_SCOPE_COLS}, run_ref, concat('context_', CAST(conv_id AS STRING), '_', CAST(user_turn AS STRING)) AS context_ref,
    constitution_ref, constitution_text, source_ref, arrival, conv_id, user_turn FROM {{selects}}""",
    "context_items": """
SELECT c.tenant_ref, c.context_ref, m.item_kind, m.version_ref AS memory_ref, c.source_ref AS query_source_ref
FROM {contexts} c JOIN (
    SELECT *, CAST(floor(created_order / (SELECT n FROM {homes})) AS BIGINT) % 4 AS slot FROM (
      SELECT home, created_order, version_ref, 'recollection' AS item_kind FROM {recollections}
      UNION ALL SELECT home, created_order, version_ref, 'disposition' FROM {dispositions}) x) m
  ON m.home = c.conv_id AND m.slot = c.user_turn % 4""",
    "context_evidence": """
SELECT c.tenant_ref, c.context_ref, e.episode_ref
FROM {contexts} c JOIN {episodes} e ON e.conv_id = c.conv_id AND e.user_turn + 2 = c.user_turn""",
    "delivery_heads": f"""
SELECT {_SCOPE_COLS}, run_ref, context_ref, concat('delivery_', CAST(conv_id AS STRING), '_', CAST(user_turn AS STRING)) AS receipt_ref,
    concat('dk-', CAST(conv_id AS STRING), '-', CAST(user_turn AS STRING)) AS idempotency_key,
    CASE WHEN conv_id % 9 = 0 THEN arrival + 15 ELSE arrival + 5 END AS arrival
FROM {{contexts}} WHERE conv_id % 4 <> 3""",
    # what each delivery claims; some claims name a memory that the context does not hold
    "delivery_refs": """
SELECT d.receipt_ref, i.memory_ref FROM {delivery_heads} d JOIN {context_items} i
  ON i.tenant_ref = d.tenant_ref AND i.context_ref = d.context_ref
UNION ALL
SELECT d.receipt_ref, e.episode_ref FROM {delivery_heads} d JOIN {context_evidence} e
  ON e.tenant_ref = d.tenant_ref AND e.context_ref = d.context_ref
UNION ALL
SELECT receipt_ref, concat(receipt_ref, '-unknown') FROM {delivery_heads} WHERE length(receipt_ref) % 5 = 2""",
    "outcome_heads": f"""
SELECT {_SCOPE_COLS}, run_ref, source_group_ref, episode_ref, reply_source AS source_event_ref, reply_text AS text,
    concat('outcome_', CAST(conv_id AS STRING), '_', CAST(user_turn AS STRING)) AS outcome_ref,
    concat('ok-', CAST(conv_id AS STRING), '-', CAST(user_turn AS STRING)) AS idempotency_key,
    CASE WHEN conv_id % 11 = 5 THEN 'agent' ELSE 'user' END AS actor_kind,
    CASE WHEN conv_id % 11 = 5 THEN 'agent' ELSE concat('user-', CAST(conv_id % 20 AS STRING)) END AS actor_ref,
    '' AS constitution_ref, '' AS constitution_text, reply_arrival AS arrival, user_source, agent_source, conv_id, user_turn
FROM {{replies}}""",
    "outcome_deliveries": """
SELECT o.outcome_ref, d.receipt_ref FROM {outcome_heads} o JOIN {delivery_heads} d
  ON d.run_ref = o.run_ref AND d.session_ref = o.session_ref
WHERE o.conv_id % 3 <> 2
UNION ALL
SELECT outcome_ref, 'delivery_unknown' FROM {outcome_heads} WHERE conv_id % 12 = 1""",
    "outcome_related": """
SELECT outcome_ref, user_source AS source_ref FROM {outcome_heads}
UNION ALL
SELECT outcome_ref, agent_source FROM {outcome_heads} WHERE conv_id % 10 <> 4
UNION ALL
SELECT outcome_ref, 'src-unknown' FROM {outcome_heads} WHERE conv_id % 14 = 6""",
    # --- queries of selection requests and what an index provider answered --------------------------
    "select_queries": f"""
SELECT {_SCOPE_COLS}, run_ref, user_source AS query_ref, user_text AS text, 0 AS query_index, conv_id, user_turn FROM {{turns}}
UNION ALL
SELECT t.tenant_ref, t.scope_kind, t.agent_ref, t.relationship_ref, t.session_ref, t.run_ref, p.user_source, p.user_text, 1, t.conv_id, t.user_turn
FROM {{turns}} t JOIN {{turns}} p ON p.conv_id = t.conv_id AND p.user_turn + 2 = t.user_turn""",
    "index_items": """
SELECT home, 'RECOLLECTION' AS kind, version_ref AS ref FROM {recollections}
UNION ALL SELECT home, 'DISPOSITION', version_ref FROM {dispositions}
UNION ALL SELECT home, 'NOTE', concat('note-', root_ref) FROM {dispositions}
UNION ALL SELECT conv_id, 'EPISODE', episode_ref FROM {episodes}""",
    "index_asks": f"""
SELECT q.tenant_ref, q.session_ref, q.run_ref, q.query_ref, q.query_index, CASE WHEN q.user_turn >= 2 THEN 2 ELSE 1 END AS n_queries,
    q.lane AS owner_index, q.scope_kind AS request_kind, q.relationship_ref AS request_relationship, q.agent_ref,
    CASE WHEN q.lane = 0 THEN 'agent' ELSE 'relationship' END AS scope_kind,
    CASE WHEN q.lane = 0 THEN '' ELSE q.relationship_ref END AS relationship_ref,
    CASE WHEN q.lane = 0 THEN q.block + (10 - q.block % 7) % 7 + ((q.conv_id * 3 + q.query_index) % 14) * 7 ELSE q.conv_id END AS home
FROM (SELECT *, EACH(0, 1) AS lane, conv_id - conv_id % 100 AS block FROM {{select_queries}}) q
WHERE q.lane = 0 OR q.scope_kind = 'relationship'""",
    "index_hits": """
SELECT a.tenant_ref, a.session_ref, a.run_ref, a.query_ref, a.query_index, a.n_queries, a.owner_index, a.agent_ref, a.scope_kind, a.relationship_ref,
    i.kind, i.ref, row_number() OVER (PARTITION BY a.session_ref, a.run_ref, a.query_ref, a.owner_index ORDER BY md5(concat(i.ref, a.query_ref)), i.ref) - 1 AS position
FROM {index_asks} a JOIN {index_items} i ON i.home = a.home""",
    # --- consolidation windows: one per conversation, related episodes from another one of the owner -----
    "window_related": f"""
SELECT DISTINCT concat('win-', CAST(w.conv_id AS STRING)) AS window_ref, w.conv_id, w.scope_kind, w.relationship_ref,
    CASE WHEN w.conv_id % 5 = 0 THEN w.conv_id WHEN w.conv_id % 7 = 3 THEN w.conv_id + 7 ELSE w.conv_id + 20 END AS related_conv FROM {{episodes}} w""",
    "window_members": """
SELECT concat('win-', CAST(conv_id AS STRING)) AS window_ref, episode_ref, 'current' AS origin, user_turn AS position FROM {episodes}
UNION ALL
SELECT w.window_ref, e.episode_ref, 'related', 1000 + e.user_turn FROM {window_related} w JOIN {episodes} e
  ON e.conv_id = w.related_conv AND e.scope_kind = w.scope_kind AND e.relationship_ref = w.relationship_ref
UNION ALL
SELECT concat('win-', CAST(conv_id AS STRING)), concat('episode_', CAST(conv_id + 20 AS STRING), '_0'), 'revision_anchor', 2000 FROM {episodes} WHERE user_turn = 0 AND conv_id % 7 <> 3 AND (conv_id + 20) % 7 <> 3""",
    "window_outcomes": """
SELECT DISTINCT m.window_ref, o.outcome_ref, o.episode_ref, o.actor_kind, o.actor_ref, o.text FROM {window_members} m JOIN {outcome_heads} o ON o.episode_ref = m.episode_ref""",
    # model outputs, one per conversation; conv_id decides the form
    "model_outputs": """
SELECT concat('win-', CAST(conv_id AS STRING)) AS window_ref, conv_id, CASE conv_id % 9
    WHEN 0 THEN concat('TARGET', n, 'NEW_RECOLLECTION', n, 'APPLICATION', n, 'OTHER', n, 'CHANGE', n, 'TEXT', n, '  likes ', CAST(conv_id % 4 AS STRING), n, n, 'BASIS', n, ep, n, 'TARGET', n, 'NEW_RECOLLECTION', n, 'APPLICATION', n, 'SELF', n, 'CHANGE', n, 'TEXT says ', CAST(conv_id AS STRING), n, 'BASIS', n, ep)
    WHEN 1 THEN concat('TARGET', n, 'NEW_RECOLLECTION', n, 'APPLICATION', n, 'NOBODY', n, 'CHANGE', n, 'TEXT x', n, 'BASIS', n, ep)
    WHEN 2 THEN concat('TARGET', n, 'NEW_RECOLLECTION', n, 'APPLICATION', n, 'OTHER', n, 'CHANGE', n, 'TEXT x', n, 'BASIS', n, ep, n, ep)
    WHEN 3 THEN repeat(concat('TARGET', n), 9000)
    WHEN 4 THEN concat(' ', n, ' ')
    WHEN 5 THEN concat('TARGET', n, rec, n, 'APPLICATION', n, app, n, 'CHANGE', n, 'KEEP', n, 'BASIS', n, ep)
    WHEN 6 THEN concat('TARGET', n, rec, n, 'APPLICATION', n, app, n, 'CHANGE', n, 'TEXT', n, 'now ', CAST(conv_id % 3 AS STRING), n, 'BASIS', n, ep)
    WHEN 7 THEN concat('TARGET', n, rec, n, 'APPLICATION', n, app, n, 'CHANGE', n, 'KEEP', n, 'BASIS', n, ep, n, 'TARGET', n, rec, n, 'APPLICATION', n, app, n, 'CHANGE', n, 'KEEP', n, 'BASIS', n, ep)
    ELSE concat('TARGET', n, 'NEW_DISPOSITION', n, 'APPLICATION', n, CASE WHEN conv_id % 7 = 3 THEN 'SELF' ELSE 'RELATION' END, n, 'CHANGE', n, 'ADAPT stay brief', n, 'BASIS', n, ep) END AS output
FROM (SELECT conv_id, chr(10) AS n, min(episode_ref) AS ep,
        concat('recollection_', CAST(conv_id + CASE WHEN conv_id % 5 = 0 THEN 100 ELSE 0 END AS STRING), '@', CAST(1 + (conv_id + CASE WHEN conv_id % 5 = 0 THEN 100 ELSE 0 END) % 3 AS STRING)) AS rec,
        CASE conv_id % 4 WHEN 0 THEN 'SELF' WHEN 1 THEN 'OTHER' WHEN 2 THEN 'RELATION' ELSE 'SITUATION' END AS app
      FROM {episodes} GROUP BY conv_id) x""",
    # --- feedback windows: a second window of each conversation that was shown a disposition; its place among 12 forms decides the change
    "feedback_seeds": """
SELECT c.conv_id, i.memory_ref AS seed, min(c.user_turn) AS t1, max(c.user_turn) AS t2
FROM {contexts} c JOIN {context_items} i ON i.tenant_ref = c.tenant_ref AND i.context_ref = c.context_ref AND i.item_kind = 'disposition'
JOIN {dispositions} d ON d.version_ref = i.memory_ref AND d.status = 'active' GROUP BY c.conv_id, i.memory_ref""",
    "feedback_changes": """
SELECT concat('fb-', CAST(conv_id AS STRING)) AS window_ref, conv_id, change_no, seed AS target, CASE WHEN form = 11 THEN 'OTHER' WHEN conv_id % 7 = 3 THEN 'SELF' ELSE 'RELATION' END AS application,
    CASE WHEN change_no = 1 OR form IN (2, 3, 10) THEN 'INHIBIT' WHEN form IN (4, 5, 11) THEN 'TEXT' WHEN form IN (6, 7) THEN 'ADAPT' ELSE 'REENACT' END AS operation,
    CASE WHEN form IN (4, 5, 11) THEN concat('calmer ', CAST(conv_id % 2 AS STRING)) WHEN form IN (6, 7) THEN 'short answers' ELSE '' END AS text,
    CASE WHEN form = 8 THEN 'episode_unknown' ELSE concat('episode_', CAST(conv_id AS STRING), '_', CAST(t1 AS STRING)) END AS b1,
    CASE WHEN change_no = 1 OR form IN (2, 4, 5, 11) THEN concat('outcome_', CAST(conv_id AS STRING), '_', CAST(t1 AS STRING))
         WHEN form IN (1, 7) AND t2 <> t1 THEN concat('episode_', CAST(conv_id AS STRING), '_', CAST(t2 AS STRING))
         WHEN form IN (7, 10) THEN concat('outcome_', CAST(conv_id AS STRING), '_', CAST(t1 + 2 AS STRING)) ELSE '' END AS b2,
    CASE WHEN form = 5 AND first <> t1 THEN concat('episode_', CAST(conv_id AS STRING), '_', CAST(first AS STRING)) ELSE '' END AS b3
FROM (SELECT f.*, CASE WHEN f.seed = g.lo THEN 0 ELSE 1 END AS change_no, CAST(floor(f.conv_id / 5) AS BIGINT) % 12 AS form, g.first
      FROM {feedback_seeds} f JOIN (SELECT s.conv_id, min(s.seed) AS lo, max(s.seed) AS hi, min(e.user_turn) AS first FROM {feedback_seeds} s JOIN {episodes} e ON e.conv_id = s.conv_id GROUP BY s.conv_id) g
        ON g.conv_id = f.conv_id AND (f.seed = g.lo OR f.seed = g.hi)) x
WHERE change_no = 0 OR form = 9""",
    "feedback_outputs": """
SELECT window_ref, conv_id, concat(max(CASE WHEN change_no = 0 THEN block ELSE '' END), max(CASE WHEN change_no = 1 THEN block ELSE '' END)) AS output
FROM (SELECT window_ref, conv_id, change_no, concat('TARGET', n, target, n, 'APPLICATION', n, application, n, 'CHANGE', n, operation, ' ', text, n, 'BASIS', n, b1, n, b2, n, b3, n) AS block
      FROM (SELECT *, chr(10) AS n FROM {feedback_changes}) y) x GROUP BY window_ref, conv_id""",
    # --- events as arrivals, jobs and index operations -----------------------------------------------
    "arrivals": """
SELECT concat('user-', CAST(user_id AS STRING)) AS owner, concat('ep-', CAST(event_id AS STRING)) AS episode_ref,
    event_id, ts FROM {events}""",
    "jobs": """
SELECT concat('user-', CAST(user_id AS STRING)) AS owner, concat('job-', CAST(event_id AS STRING)) AS job_ref, event_id AS job_order,
    event_type = 'view' OR event_type = 'click' AS completed FROM {events}""",
    "op_log": """
SELECT concat('stream-', CAST(user_id AS STRING)) AS stream_ref, concat('op-', CAST(event_id AS STRING)) AS operation_id, event_id AS arrival,
    CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPSERT' END AS action,
    concat('doc-', CAST(user_id AS STRING), '-', CAST(event_id % 7 AS STRING)) AS document_ref,
    event_id % 3 = 0 AS acknowledged FROM {events}""",
    # --- evaluation results --------------------------------------------------------------------------
    "graded": """
SELECT *, CASE mode WHEN 'none' THEN 0 WHEN 'full_history' THEN 1 WHEN 'oracle_episode' THEN 2
    WHEN 'semantic_top40' THEN 3 WHEN 'current_core' THEN 4 ELSE 5 END AS mode_no
FROM (SELECT doc_id, EACH('none', 'full_history', 'oracle_episode', 'semantic_top40', 'current_core', 'learned_core') AS mode
      FROM {labels}) x""",
    "results": """
SELECT concat('row-', CAST(m.doc_id AS STRING)) AS question_ref, concat('persona-', CAST(CAST(floor(m.doc_id / 25) AS BIGINT) AS STRING)) AS persona_id, m.mode,
    substr(md5(concat(CAST(m.doc_id AS STRING), m.mode)), 1, 1) < substr('3579bd', m.mode_no + 1, 1) AS correct,
    CASE WHEN m.doc_id % 17 = m.mode_no THEN '' ELSE 'A' END AS predicted_option,
    CASE WHEN m.mode = 'none' THEN 0 ELSE d.n_chars % 1000 END AS memory_tokens,
    m.mode = 'oracle_episode' AS oracle_label_used,
    CASE WHEN m.doc_id % 97 = 5 AND m.mode = 'full_history' THEN 'timeout' ELSE '' END AS error,
    d.lang AS pref_type, d.source AS who
FROM {graded} m JOIN {documents} d ON d.doc_id = m.doc_id""",
    "diagnostics": """
SELECT concat('row-', CAST(doc_id AS STRING)) AS question_ref, concat('persona-', CAST(CAST(floor(doc_id / 25) AS BIGINT) AS STRING)) AS persona_id,
    h < 'e' AS source_available, h < 'b' AS indexed, h < '8' AS selected, h < '6' AS delivered,
    g < '4' AS learned_basis_selected, g < '2' AS learned_basis_delivered,
    substr(md5(concat(CAST(doc_id AS STRING), 'current_core')), 1, 1) < 'b' AS answer_correct
FROM (SELECT doc_id, substr(md5(CAST(doc_id AS STRING)), 1, 1) AS h, substr(md5(concat('b', CAST(doc_id AS STRING))), 1, 1) AS g FROM {labels}) x""",
    "judged": """
SELECT concat('inst-', CAST(doc_id AS STRING)) AS instance_ref, concat('persona-', CAST(CAST(floor(doc_id / 25) AS BIGINT) AS STRING)) AS persona_id,
    CASE doc_id % 3 WHEN 0 THEN 'consistent' WHEN 1 THEN 'contrastive' ELSE 'changing' END AS instance_type,
    CASE WHEN quality = 1 THEN 'dev' ELSE 'holdout' END AS split, a.arm,
    1 + CAST(floor((ascii(substr(md5(concat(CAST(doc_id AS STRING), a.arm)), 1, 1)) % 16) * 0.6) AS BIGINT) AS score,
    a.arm <> 'none' AND substr(md5(concat(a.arm, CAST(doc_id AS STRING))), 1, 1) < '9' AS rendered,
    a.arm = 'seed_enabled' AND substr(md5(concat('s', CAST(doc_id AS STRING))), 1, 1) < '7' AS seed_rendered
FROM (SELECT doc_id, quality, EACH('none', 'recollection_only', 'seed_enabled') AS arm FROM {labels}) a""",
    "pairwise": """
SELECT concat('probe-', CAST(doc_id AS STRING)) AS probe_ref, c.comparison,
    CASE WHEN f < '6' THEN 'A' WHEN f < 'c' THEN 'B' ELSE 'TIE' END AS forward_token,
    CASE WHEN f < '6' THEN CASE WHEN r < 'd' THEN 'B' ELSE 'A' END
         WHEN f < 'c' THEN CASE WHEN r < 'e' THEN 'A' ELSE 'TIE' END
         ELSE CASE WHEN r < 'e' THEN 'TIE' ELSE 'B' END END AS reverse_token
FROM (SELECT p.doc_id, p.comparison, substr(md5(concat(CAST(p.doc_id AS STRING), p.comparison)), 1, 1) AS f,
             substr(md5(concat(p.comparison, CAST(p.doc_id AS STRING))), 1, 1) AS r
      FROM (SELECT doc_id, EACH('learned-rag', 'learned-oracle', 'oracle-rag', 'anti-rag') AS comparison FROM {labels}) p) c""",
}

# Views of a few bytes a row in their files: Spark would take millions of rows for a small table and send them through the driver.
PACKED = frozenset({"graded"})


def _each(text: str, form: str) -> str:
    return re.sub(r"EACH\(([^)]*)\)", form, text)


def _needs(name: str) -> list[str]:
    return sorted({field for _, field, _, _ in Formatter().parse(VIEWS[name]) if field})


class Tables:
    """Lazy access to driver tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in DRIVER_TABLES:
                self._made[name] = self._read(name)
            else:
                needs = {n: self(n).hint("merge") if n in PACKED else self(n) for n in _needs(name)}
                self._made[name] = self.spark.sql(_each(VIEWS[name], r"explode(array(\1))"), **needs)
        return self._made[name]

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A joined table that several branches of a query read: made once, cut from its lineage."""
        key = "once:" + name
        if key not in self._made:
            self._made[key] = cut_lineage(make())
        return self._made[key]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _ordered(names: tuple[str, ...]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in DRIVER_TABLES or name in done:
            return
        for need in _needs(name):
            visit(need)
        done.append(name)

    for name in names:
        visit(name)
    return done


def sql_with(*names: str, extra: str = "") -> str:
    """``WITH`` clause that defines the named views (and ``extra`` CTEs) for a SQL check."""
    parts = []
    for name in _ordered(names):
        text = _each(VIEWS[name], r"unnest([\1])").format(**{n: n for n in _needs(name)})
        parts.append(f"{name} AS ({text})")
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
