"""Queries over validation, admission and feedback."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import refs
from ..operators import feedback, intake
from ..plans.bindings import Tables, sql_with
from ..plans.session import shared_folder
from ..streaming.intake_table import IntakeTable
from .registry import query
from .sqltext import EPISODE_REF, GROUP, SCOPE_FIELDS, hash_sql

_SPACE = r"'\s'"
_TIGHT = "({c} <> '' AND octet_length(encode({c})) <= 384 AND NOT regexp_matches({c}, '\\s'))"
_STABLE = "({c} <> '' AND octet_length(encode({c})) <= 384)"


def _tight(c: str) -> str:
    return _TIGHT.replace("{c}", c)


def _stable(c: str) -> str:
    return _STABLE.replace("{c}", c)


_KIND_OK = ("(CASE scope_kind WHEN 'agent' THEN relationship_ref = '' WHEN 'relationship' THEN relationship_ref <> '' "
            "ELSE false END)")
_SCOPE_OK = (f"({_stable('tenant_ref')} AND {_stable('agent_ref')} AND octet_length(encode(relationship_ref)) <= 384 "
             "AND octet_length(encode(session_ref)) <= 384)")
SOURCE_REASON = f"""CASE
 WHEN contains(constitution_ref, chr(0)) OR contains(constitution_text, chr(0)) THEN 'constitution_nul'
 WHEN (constitution_ref = '') <> (constitution_text = '') OR (constitution_ref <> '' AND NOT {_tight('constitution_ref')})
   OR octet_length(encode(constitution_text)) > 65536 THEN 'constitution'
 WHEN NOT {_stable('source_ref')} THEN 'source_ref'
 WHEN NOT {_SCOPE_OK} THEN 'scope_refs'
 WHEN NOT {_KIND_OK} THEN 'scope_kind'
 WHEN actor_kind NOT IN ('agent','user','system','tool','external') OR NOT {_stable('actor_ref')} THEN 'actor'
 WHEN text = '' THEN 'text_empty'
 WHEN octet_length(encode(text)) > 65536 THEN 'text_too_long' END"""
BINDING = """CASE WHEN octet_length(encode(run_ref)) > 384 OR octet_length(encode(source_group_ref)) > 384 THEN 'binding_refs'
 WHEN run_ref = '' OR source_group_ref = '' THEN 'none'
 WHEN role NOT IN ('situation','agent_act','outcome') THEN 'role'
 WHEN role = 'agent_act' AND (actor_kind <> 'agent' OR actor_ref <> agent_ref) THEN 'agent_act_actor' ELSE 'ok' END"""


@query("p01_validate_sources", sql_with("dirty_requests") + f"SELECT idempotency_key, arrival, {SOURCE_REASON} AS reason FROM dirty_requests")
def _(t: Tables):
    return intake.validate_sources(t("dirty_requests")).select("idempotency_key", "arrival", "reason")


@query("p02_validate_bindings", sql_with("dirty_requests") + f"SELECT idempotency_key, arrival, {BINDING} AS binding FROM dirty_requests")
def _(t: Tables):
    return intake.validate_bindings(t("dirty_requests")).select("idempotency_key", "arrival", "binding")


def deliveries(t: Tables):
    """Delivery requests with their references as an array (bounded by one context)."""
    refs_of = t("delivery_refs").groupBy("receipt_ref").agg(F.sort_array(F.collect_list("memory_ref")).alias("memory_refs"))
    none = F.array().cast("array<string>")
    return t("delivery_heads").join(refs_of, "receipt_ref", "left").withColumn("memory_refs", F.coalesce("memory_refs", none))


def outcomes(t: Tables):
    none = F.array().cast("array<string>")
    receipts = t("outcome_deliveries").groupBy("outcome_ref").agg(F.sort_array(F.collect_list("receipt_ref")).alias("receipt_refs"))
    related = t("outcome_related").groupBy("outcome_ref").agg(F.sort_array(F.collect_list("source_ref")).alias("related_refs"))
    return (
        t("outcome_heads").withColumnRenamed("source_event_ref", "source_ref")
        .join(receipts, "outcome_ref", "left").join(related, "outcome_ref", "left")
        .withColumn("receipt_refs", F.coalesce("receipt_refs", none))
        .withColumn("related_refs", F.coalesce("related_refs", none)))


def acts(t: Tables):
    return t("turns").select(*feedback.RUN, (F.col("arrival") + 10).alias("arrival"))


_ARRAYS = """d AS (SELECT h.*, coalesce(r.refs, []) AS memory_refs FROM delivery_heads h
  LEFT JOIN (SELECT receipt_ref, list(memory_ref ORDER BY memory_ref) AS refs FROM delivery_refs GROUP BY 1) r USING (receipt_ref)),
o AS (SELECT h.*, coalesce(r.refs, []) AS receipt_refs, coalesce(s.refs, []) AS related_refs FROM outcome_heads h
  LEFT JOIN (SELECT outcome_ref, list(receipt_ref ORDER BY receipt_ref) AS refs FROM outcome_deliveries GROUP BY 1) r USING (outcome_ref)
  LEFT JOIN (SELECT outcome_ref, list(source_ref ORDER BY source_ref) AS refs FROM outcome_related GROUP BY 1) s USING (outcome_ref))"""
_FEEDBACK_VIEWS = ("delivery_heads", "delivery_refs", "outcome_heads", "outcome_deliveries", "outcome_related",
                   "contexts", "context_items", "context_evidence", "turns", "links", "episodes", "dispositions",
                   "seed_basis")
_FB = sql_with(*_FEEDBACK_VIEWS, extra=_ARRAYS)
_UNIQUE = "(len(list_distinct({a})) = len({a}) AND len(list_filter({a}, lambda r: NOT " + _tight("r") + ")) = 0)"
DELIVERY_REASON = f"""CASE WHEN NOT {_stable('idempotency_key')} THEN 'idempotency_key'
 WHEN NOT {_tight('run_ref')} THEN 'run_ref' WHEN NOT {_tight('context_ref')} THEN 'context_ref'
 WHEN len(memory_refs) = 0 THEN 'no_refs' WHEN NOT {_UNIQUE.replace('{a}', 'memory_refs')} THEN 'refs'
 WHEN NOT {_SCOPE_OK} OR NOT {_KIND_OK} THEN 'scope' END"""


@query("p03_validate_deliveries", _FB + f"""SELECT receipt_ref, {DELIVERY_REASON.replace('memory_refs', 'list_transform(memory_refs, lambda x: replace(x, chr(45) || chr(117), chr(32)))')} AS reason FROM d""")
def _(t: Tables):
    # unknown references are turned into references with a blank, which must be refused
    spaced = deliveries(t).withColumn("memory_refs", F.transform("memory_refs", lambda r: F.replace(r, F.lit("-u"), F.lit(" "))))
    return intake.validate_deliveries(spaced).select("receipt_ref", "reason")


@query("p04_validate_outcomes", _FB + f"""SELECT outcome_ref,
 CASE WHEN NOT {_UNIQUE.replace('{a}', 'receipt_refs')} THEN 'receipt_refs' WHEN NOT {_UNIQUE.replace('{a}', 'related_refs')} THEN 'related_refs'
  ELSE {SOURCE_REASON.replace('source_ref', 'source_event_ref')} END AS reason
 FROM (SELECT * REPLACE (CASE WHEN length(text) % 7 = 3 THEN list_concat(related_refs, related_refs) ELSE related_refs END AS related_refs,
    CASE WHEN length(text) % 11 = 4 THEN '' ELSE text END AS text) FROM o)""")
def _(t: Tables):
    dirty = (
        outcomes(t)
        .withColumn("related_refs", F.when(F.length("text") % 7 == 3, F.concat("related_refs", "related_refs")).otherwise(F.col("related_refs")))
        .withColumn("text", F.when(F.length("text") % 11 == 4, "").otherwise(F.col("text"))))
    return intake.validate_outcomes(dirty).select("outcome_ref", "reason")


@query("p05_validate_selects", sql_with("selects") + f"""SELECT run_ref, source_ref, CASE
 WHEN NOT {_tight('run_ref')} THEN 'run_ref' WHEN user_turn % 6 = 4 THEN 'situation_refs'
 WHEN evidence_bytes + length(text) * 60 NOT BETWEEN 0 AND 16384 THEN 'evidence_bytes'
 WHEN tenant_ref = '' OR agent_ref = '' THEN 'scope_refs' WHEN NOT {_KIND_OK} THEN 'scope_kind'
 WHEN (constitution_ref = '') <> (ctext = '') OR (constitution_ref <> '' AND NOT {_tight('constitution_ref')}) THEN 'constitution' END AS reason
 FROM (SELECT *, CASE WHEN conv_id % 12 = 6 THEN '' ELSE constitution_text END AS ctext FROM selects)""")
def _(t: Tables):
    df = (
        t("selects").withColumn("situation_refs", F.when(F.col("user_turn") % 6 == 4, F.array("source_ref", "source_ref")).otherwise(F.array("source_ref")))
        .withColumn("evidence_bytes", F.col("evidence_bytes") + F.length("text") * 60)
        .withColumn("constitution_text", F.when(F.col("conv_id") % 12 == 6, "").otherwise(F.col("constitution_text"))))
    return intake.validate_selects(df).select("run_ref", "source_ref", "reason")


_OBSERVE = ("source_ref", *SCOPE_FIELDS, "actor_kind", "actor_ref", "text", "run_ref", "source_group_ref", "role")
_REQ_HASH = (f"CASE WHEN constitution_ref <> '' OR constitution_text <> '' THEN "
             f"{hash_sql('observe-request.v2', *_OBSERVE, chr(39) + 'constitution.v1' + chr(39), 'constitution_ref', 'constitution_text')} "
             f"ELSE {hash_sql('observe-request.v1', *_OBSERVE)} END")


@query("f03_request_hashes", sql_with("requests") + f"SELECT idempotency_key, arrival, {_REQ_HASH} AS request_hash FROM requests")
def _(t: Tables):
    return t("requests").select("idempotency_key", "arrival", refs.observe_hash().alias("request_hash"))


_SEL_PLAIN = ("scope_kind", "tenant_ref", "agent_ref", "relationship_ref", "session_ref", "run_ref", "constitution_ref", "constitution_text", "source_ref")


@query("f03_select_hashes", sql_with("selects") + f"""SELECT run_ref, h AS request_hash, 'context_' || substr(h, 1, 32) AS context_ref FROM (
 SELECT run_ref, CASE WHEN evidence_bytes = 0 THEN {hash_sql('memory-context-request.v2', *_SEL_PLAIN)}
 ELSE {hash_sql('memory-context-request.episode-evidence.v1', 'CAST(evidence_bytes AS VARCHAR)', "'memory-context-request.v2'", *_SEL_PLAIN)} END AS h FROM selects)""")
def _(t: Tables):
    h = refs.select_hash(F.array("source_ref"), F.col("evidence_bytes"))
    return t("selects").select("run_ref", h.alias("request_hash")).withColumn("context_ref", refs.context_ref(F.col("request_hash")))


@query("f01_f02_stable_refs", sql_with("outcome_heads", "delivery_heads") + f"""
SELECT 'episode' AS kind, run_ref AS id, {EPISODE_REF} AS ref FROM outcome_heads
UNION ALL SELECT 'outcome', run_ref, 'outcome_' || substr({hash_sql('outcome-event-identity.v1', *SCOPE_FIELDS, 'run_ref', 'source_group_ref', 'source_event_ref', 'idempotency_key')}, 1, 32) FROM outcome_heads
UNION ALL SELECT 'delivery', run_ref, 'delivery_' || substr({hash_sql('memory-delivery-receipt.v2', 'tenant_ref', 'idempotency_key')}, 1, 32) FROM delivery_heads
UNION ALL SELECT 'stream', run_ref, 'memory_index_stream_' || substr({hash_sql('memory-index-stream.v1', 'tenant_ref', "'EPISODE'", 'run_ref')}, 1, 32) FROM delivery_heads
UNION ALL SELECT 'operation', run_ref, 'memory_index_operation_' || substr({hash_sql('memory-index-operation.v1', 'run_ref', "'UPSERT'", "'EPISODE'", 'context_ref', 'idempotency_key')}, 1, 32) FROM delivery_heads""")
def _(t: Tables):
    o, d = t("outcome_heads"), t("delivery_heads")

    def part(df, kind, ref):
        return df.select(F.lit(kind).alias("kind"), F.col("run_ref").alias("id"), ref.alias("ref"))

    return (
        part(o, "episode", refs.episode_ref()).unionByName(part(o, "outcome", refs.outcome_ref()))
        .unionByName(part(d, "delivery", refs.delivery_ref()))
        .unionByName(part(d, "stream", refs.stream_ref(F.lit("EPISODE"), "run_ref")))
        .unionByName(part(d, "operation", refs.operation_id(F.col("run_ref"), F.lit("UPSERT"), F.lit("EPISODE"), "context_ref", "idempotency_key"))))


_FIRST = """SELECT *, first_value(request_hash) OVER w AS fh, first_value(arrival) OVER w AS fa
 FROM ({src}) WINDOW w AS (PARTITION BY tenant_ref, idempotency_key ORDER BY arrival)"""


@query("w03_first_accept", sql_with("requests") + f"""SELECT idempotency_key, arrival,
 CASE WHEN arrival = fa THEN 'new' WHEN request_hash = fh THEN 'replay' ELSE 'conflict' END AS status
 FROM ({_FIRST.replace('{src}', f'SELECT *, {_REQ_HASH} AS request_hash FROM requests')})""")
def _(t: Tables):
    hashed = t("requests").withColumn("request_hash", refs.observe_hash())
    return intake.first_accept(hashed, ["tenant_ref", "idempotency_key"], "request_hash").select("idempotency_key", "arrival", "status")


@query("w04_first_source", sql_with("requests") + """SELECT source_ref, arrival,
 CASE WHEN arrival = first_value(arrival) OVER w THEN 'new'
      WHEN text = first_value(text) OVER w AND actor_ref = first_value(actor_ref) OVER w AND actor_kind = first_value(actor_kind) OVER w
       AND constitution_ref = first_value(constitution_ref) OVER w AND constitution_text = first_value(constitution_text) OVER w THEN 'same'
      ELSE 'conflict' END AS source_status
 FROM requests WINDOW w AS (PARTITION BY tenant_ref, scope_kind, agent_ref, relationship_ref, session_ref, source_ref ORDER BY arrival)""")
def _(t: Tables):
    return intake.first_source(t("requests")).select("source_ref", "arrival", "source_status")


_GATES = """g AS (SELECT {G}, max(s) AS s, max(a) AS a, list_sort(list(seen))[2] AS second FROM (
   SELECT {G}, source_ref, min(arrival) AS seen,
     min(min(CASE WHEN role = 'situation' THEN arrival END)) OVER (PARTITION BY {G}) AS s,
     min(min(CASE WHEN role = 'agent_act' THEN arrival END)) OVER (PARTITION BY {G}) AS a
   FROM {src} WHERE role <> 'outcome' GROUP BY {G}, source_ref) GROUP BY {G}),
 gate AS (SELECT {G}, greatest(s, a, second) AS gate FROM g WHERE s IS NOT NULL AND a IS NOT NULL AND second IS NOT NULL)"""


def _gates(src: str) -> str:
    return _GATES.replace("{G}", GROUP).replace("{src}", src)


@query("w02_sealing", sql_with("link_log", extra=_gates("link_log")) + f"""
SELECT run_ref, source_ref, role, arrival, gate IS NULL OR arrival <= gate OR role = 'outcome'
   OR min(arrival) OVER (PARTITION BY {GROUP}, source_ref, role) <= gate AS accepted
FROM link_log LEFT JOIN gate USING ({GROUP})""")
def _(t: Tables):
    return intake.sealing(t("link_log")).select("run_ref", "source_ref", "role", "arrival", "accepted")


@query("a01_materialize_episodes", sql_with("link_log") + f"""
SELECT DISTINCT s.run_ref, {EPISODE_REF.replace('run_ref', 's.run_ref')
    .replace('scope_kind', 's.scope_kind').replace('tenant_ref', 's.tenant_ref').replace('agent_ref', 's.agent_ref')
    .replace('relationship_ref', 's.relationship_ref').replace('session_ref', 's.session_ref').replace('source_group_ref', 's.source_group_ref')} AS episode_ref
FROM link_log s JOIN link_log a USING ({GROUP}) WHERE s.role = 'situation' AND a.role = 'agent_act' AND s.source_ref <> a.source_ref""")
def _(t: Tables):
    return intake.materialize_episodes(t("link_log")).select("run_ref", "episode_ref")


@query("j10_late_outcome_backfill", sql_with("outcome_heads", "link_log") + f"""
SELECT o.outcome_ref, coalesce(e.episode_ref, '') AS episode_ref FROM outcome_heads o LEFT JOIN (
  SELECT {GROUP}, {EPISODE_REF} AS episode_ref FROM link_log GROUP BY {GROUP}
  HAVING bool_or(role = 'situation') AND bool_or(role = 'agent_act') AND count(DISTINCT CASE WHEN role <> 'outcome' THEN source_ref END) > 1) e
 USING ({GROUP})""")
def _(t: Tables):
    early = t("outcome_heads").withColumn("episode_ref", F.lit(""))
    return intake.backfill_outcomes(early, intake.materialize_episodes(t("link_log"))).select("outcome_ref", "episode_ref")


# A walk through the rows of each session in arrival order, with what has been accepted so far; knows nothing of sets or rounds.
# walked: k key, h request, s source, p payload, g group, src, role, refusal, arrival, ep the episode of the group, tenant, session
_WALK = """ordered AS (SELECT *, row_number() OVER (PARTITION BY tenant, session ORDER BY arrival, h) AS n FROM walked),
walk AS (
 SELECT DISTINCT tenant, session, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k VARCHAR, h VARCHAR, s VARCHAR, p VARCHAR, g VARCHAR, src VARCHAR, role VARCHAR, e VARCHAR, o VARCHAR)[]) AS acc,
   CAST(NULL AS VARCHAR) AS k, CAST(0 AS BIGINT) AS arrival, CAST(NULL AS VARCHAR) AS status, CAST('' AS VARCHAR) AS e, CAST('' AS VARCHAR) AS o FROM ordered
 UNION ALL
 SELECT tenant, session, n, CASE WHEN status = 'accepted' THEN list_append(acc, struct_pack(k := k, h := h, s := s, p := p, g := g, src := src, role := role, e := e2, o := own)) ELSE acc END,
   k, arrival, status, CASE status WHEN 'accepted' THEN e2 WHEN 'replay' THEN same[1].e ELSE '' END, CASE status WHEN 'accepted' THEN own WHEN 'replay' THEN same[1].o ELSE '' END
 FROM (SELECT *, CASE WHEN len(same) > 0 THEN CASE WHEN same[1].h = h THEN 'replay' ELSE 'conflict' END
     WHEN refusal IS NOT NULL THEN refusal
     WHEN len(list_filter(acc, lambda a: a.s = s AND a.p <> p)) > 0 OR old <> p THEN 'source_conflict'
     WHEN g <> '' AND role <> 'outcome' AND whole AND len(list_filter(grp, lambda a: a.src = src AND a.role = role)) = 0 THEN 'sealed'
     ELSE 'accepted' END AS status,
   CASE WHEN fixed IS NOT NULL THEN fixed WHEN g <> '' AND (whole OR (len(list_filter(more, lambda a: a.role = 'situation')) > 0 AND len(list_filter(more, lambda a: a.role = 'agent_act')) > 0
     AND len(list_distinct(list_transform(list_filter(more, lambda a: a.role <> 'outcome'), lambda a: a.src))) > 1)) THEN ep ELSE '' END AS e2
  FROM (SELECT *, list_append(grp, struct_pack(k := k, h := h, s := s, p := p, g := g, src := src, role := role, e := '', o := '')) AS more,
     len(list_filter(grp, lambda a: a.role = 'situation')) > 0 AND len(list_filter(grp, lambda a: a.role = 'agent_act')) > 0
      AND len(list_distinct(list_transform(list_filter(grp, lambda a: a.role <> 'outcome'), lambda a: a.src))) > 1 AS whole
   FROM (SELECT w.acc, r.*, list_filter(w.acc, lambda a: a.k = r.k) AS same, list_filter(w.acc, lambda a: a.g = r.g AND r.g <> '') AS grp
     FROM walk w JOIN ordered r ON r.tenant = w.tenant AND r.session = w.session AND r.n = w.n + 1))))"""
_SRC_KEY = "concat_ws('|', scope_kind, agent_ref, relationship_ref, session_ref, source_ref)"
_PAYLOAD = "concat_ws('|', actor_kind, actor_ref, text, constitution_ref, constitution_text)"
_INTAKE = sql_with("dirty_requests", extra=f"""checked AS (SELECT *, coalesce({SOURCE_REASON}, CASE WHEN {BINDING} NOT IN ('ok', 'none') THEN {BINDING} END) AS reason,
   {_REQ_HASH} AS request_hash FROM dirty_requests),
walked AS (SELECT tenant_ref AS tenant, session_ref AS session, arrival, idempotency_key AS k, request_hash AS h, {_SRC_KEY} AS s, {_PAYLOAD} AS p,
   CASE WHEN run_ref = '' OR source_group_ref = '' THEN '' ELSE concat_ws('|', scope_kind, agent_ref, relationship_ref, run_ref, source_group_ref) END AS g, source_ref AS src, role,
   CAST(NULL AS VARCHAR) AS refusal, CAST(NULL AS VARCHAR) AS old, {EPISODE_REF} AS ep, CAST(NULL AS VARCHAR) AS fixed, '' AS own FROM checked WHERE reason IS NULL),
{_WALK}""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("c01_intake_job", _INTAKE + """SELECT k AS idempotency_key, arrival, status, e AS episode_ref FROM walk WHERE n > 0
UNION ALL SELECT idempotency_key, arrival, 'invalid:' || reason, '' FROM checked WHERE reason IS NOT NULL""")
def _(t: Tables):
    return intake.intake_job(t("dirty_requests")).select("idempotency_key", "arrival", "status", "episode_ref")


@query("x01_stream_intake", _INTAKE + """SELECT k AS idempotency_key, arrival, status, e AS episode_ref FROM walk WHERE n > 0
UNION ALL SELECT idempotency_key, arrival, 'invalid:' || reason, '' FROM checked WHERE reason IS NOT NULL""")
def _(t: Tables):
    table = IntakeTable(t.spark, f"{shared_folder(t.spark)}/intake-{uuid.uuid4().hex}")
    requests = t.once("dirty_requests", lambda: t("dirty_requests"))
    ends = requests.agg(F.min("arrival").alias("lo"), F.max("arrival").alias("hi")).first()
    part = F.floor((F.col("arrival") - ends["lo"]) * 3 / (ends["hi"] - ends["lo"] + 1))
    # three batches in the order of arrival; the second one comes twice
    answers = [table.apply(requests.filter(part == k), k) for k in (0, 1, 1, 2)]
    return answers[0].unionByName(answers[2]).unionByName(answers[3]).select("idempotency_key", "arrival", "status", "episode_ref")


_CLAIMS = """claims AS (SELECT context_ref, memory_ref, item_kind AS kind FROM context_items
  UNION SELECT context_ref, constitution_ref, 'constitution' FROM contexts WHERE constitution_ref <> ''
  UNION SELECT context_ref, episode_ref, 'episode_evidence' FROM context_evidence)"""
_DELIVERY_REASON = """CASE WHEN d.arrival > (SELECT min(t.arrival) + 10 FROM turns t WHERE t.run_ref = d.run_ref AND t.session_ref = d.session_ref) THEN 'after_act'
  WHEN NOT EXISTS (SELECT 1 FROM contexts c WHERE c.context_ref = d.context_ref AND c.run_ref = d.run_ref AND c.session_ref = d.session_ref) THEN 'context'
  WHEN EXISTS (SELECT 1 FROM claims c WHERE c.context_ref = d.context_ref GROUP BY c.memory_ref HAVING count(DISTINCT c.kind) > 1) THEN 'ambiguous_ref'
  WHEN EXISTS (SELECT 1 FROM delivery_refs r WHERE r.receipt_ref = d.receipt_ref AND NOT EXISTS (
     SELECT 1 FROM claims c WHERE c.context_ref = d.context_ref AND c.memory_ref = r.memory_ref)) THEN 'unknown_ref' END"""


@query("j08_admit_deliveries", sql_with(*_FEEDBACK_VIEWS, extra=_ARRAYS + ",\n" + _CLAIMS) + f"SELECT d.receipt_ref, {_DELIVERY_REASON} AS reason FROM d")
def _(t: Tables):
    return feedback.admit_deliveries(deliveries(t), t("contexts"), t("context_items"), t("context_evidence"), acts(t)).select("receipt_ref", "reason")


@query("u07_claim_refs", sql_with(*_FEEDBACK_VIEWS, extra=_CLAIMS) + """SELECT context_ref, memory_ref, min(kind) AS kind, count(DISTINCT kind) > 1 AS ambiguous
FROM (SELECT context_ref, CASE WHEN memory_ref = 'constitution-0' AND length(context_ref) % 2 = 0 THEN 'recollection_0@1' ELSE memory_ref END AS memory_ref, kind FROM claims) GROUP BY 1, 2""")
def _(t: Tables):
    # some constitutions reuse the name of a recollection, which must surface as ambiguous
    renamed = t("contexts").withColumn("constitution_ref", F.when(
        (F.col("constitution_ref") == "constitution-0") & (F.length("context_ref") % 2 == 0), "recollection_0@1").otherwise(F.col("constitution_ref")))
    return feedback.claimed_refs(renamed, t("context_items"), t("context_evidence")).select("context_ref", "memory_ref", "kind", "ambiguous")


_OUTCOME_REASON = f"""CASE WHEN EXISTS (SELECT 1 FROM outcome_deliveries r WHERE r.outcome_ref = o.outcome_ref AND NOT EXISTS (
     SELECT 1 FROM delivery_heads d WHERE d.receipt_ref = r.receipt_ref AND d.run_ref = o.run_ref AND d.session_ref = o.session_ref)) THEN 'unknown_receipt'
  WHEN EXISTS (SELECT 1 FROM outcome_related r WHERE r.outcome_ref = o.outcome_ref AND NOT EXISTS (
     SELECT 1 FROM links l WHERE l.source_ref = r.source_ref AND l.run_ref = o.run_ref AND l.session_ref = o.session_ref)) THEN 'unrelated_source'
  WHEN EXISTS (SELECT 1 FROM outcome_deliveries r WHERE r.outcome_ref = o.outcome_ref) AND NOT EXISTS (
     SELECT 1 FROM outcome_related r JOIN links l ON l.source_ref = r.source_ref WHERE r.outcome_ref = o.outcome_ref
       AND l.run_ref = o.run_ref AND l.session_ref = o.session_ref AND l.role = 'agent_act') THEN 'no_act' END"""


@query("j09_admit_outcomes", _FB + f"SELECT o.outcome_ref, {_OUTCOME_REASON} AS reason FROM o")
def _(t: Tables):
    return feedback.admit_outcomes(outcomes(t), t("delivery_heads"), t("links")).select("outcome_ref", "reason")


def again(df, refs_col, unknown):
    """Requests and what follows them: a retry without the unknown reference, and the key with other references."""
    kept = F.filter(refs_col, lambda r: ~r.contains(unknown))
    return (
        df.unionByName(df.filter("conv_id % 5 IN (0, 1)").withColumn(refs_col, kept).withColumn("arrival", F.col("arrival") + 1))
        .unionByName(df.filter("conv_id % 5 IN (1, 2)").withColumn(refs_col, F.slice(kept, 1, 1)).withColumn("arrival", F.col("arrival") + 2))
        .unionByName(df.filter("conv_id % 5 = 0").withColumn(refs_col, kept).withColumn("arrival", F.col("arrival") + 3)))


def _again(src: str, refs_col: str, unknown: str) -> str:
    kept = f"list_filter({refs_col}, lambda r: NOT contains(r, '{unknown}'))"
    return f"""(SELECT * FROM {src} UNION ALL SELECT * REPLACE ({kept} AS {refs_col}, arrival + 1 AS arrival) FROM {src} WHERE conv_id % 5 IN (0, 1)
 UNION ALL SELECT * REPLACE ({kept}[1:1] AS {refs_col}, arrival + 2 AS arrival) FROM {src} WHERE conv_id % 5 IN (1, 2)
 UNION ALL SELECT * REPLACE ({kept} AS {refs_col}, arrival + 3 AS arrival) FROM {src} WHERE conv_id % 5 = 0)"""


def numbered(df, ref):
    """Deliveries or outcomes with the number of their conversation and a reference for each request."""
    return df.withColumn("conv_id", F.split("session_ref", "-")[1].cast("bigint")).withColumn(ref, F.concat(ref, F.lit("~"), F.col("arrival")))


_NAMED = "SELECT *, CAST(split_part(session_ref, '-', 2) AS BIGINT) AS conv_id FROM d"
_D2 = f"""d2 AS (SELECT * FROM {_again('(' + _NAMED + ')', 'memory_refs', '-unknown')}),
d3 AS (SELECT *, {DELIVERY_REASON} AS invalid, CASE WHEN d.arrival > (SELECT min(t.arrival) + 10 FROM turns t WHERE t.run_ref = d.run_ref AND t.session_ref = d.session_ref) THEN 'after_act'
  WHEN NOT EXISTS (SELECT 1 FROM contexts c WHERE c.context_ref = d.context_ref AND c.run_ref = d.run_ref AND c.session_ref = d.session_ref) THEN 'context'
  WHEN EXISTS (SELECT 1 FROM claims c WHERE c.context_ref = d.context_ref GROUP BY c.memory_ref HAVING count(DISTINCT c.kind) > 1) THEN 'ambiguous_ref'
  WHEN len(list_filter(memory_refs, lambda r: NOT list_contains(shown, r))) > 0 THEN 'unknown_ref' END AS refusal FROM (SELECT *, coalesce((SELECT list(c.memory_ref) FROM claims c WHERE c.context_ref = d2.context_ref), []) AS shown FROM d2) d),
walked AS (SELECT tenant_ref AS tenant, session_ref AS session, arrival, idempotency_key AS k, concat_ws('|', run_ref, context_ref, array_to_string(list_sort(memory_refs), ',')) AS h, 'x' AS s, 'x' AS p, '' AS g, '' AS src, '' AS role,
  refusal, CAST(NULL AS VARCHAR) AS old, '' AS ep, CAST(NULL AS VARCHAR) AS fixed, 'delivery_' || substr({hash_sql('memory-delivery-receipt.v2', 'tenant_ref', 'idempotency_key')}, 1, 32) AS own FROM d3 WHERE invalid IS NULL),
{_WALK}"""


@query("c02_delivery_job", sql_with(*_FEEDBACK_VIEWS, extra=_ARRAYS + ",\n" + _CLAIMS + ",\n" + _D2).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT k AS idempotency_key, arrival, status, o AS delivery_ref FROM walk WHERE n > 0
UNION ALL SELECT idempotency_key, arrival, 'invalid:' || invalid, '' FROM d3 WHERE invalid IS NOT NULL""")
def _(t: Tables):
    asked = numbered(again(numbered(deliveries(t), "receipt_ref"), "memory_refs", "-unknown"), "receipt_ref")
    return feedback.delivery_job(asked, t("contexts"), t("context_items"), t("context_evidence"), acts(t)).select("idempotency_key", "arrival", "status", "delivery_ref")


_O2 = f"""o2 AS (SELECT * FROM {_again('o', 'receipt_refs', '_unknown')}),
o3 AS (SELECT *, CASE WHEN NOT {_UNIQUE.replace('{a}', 'receipt_refs')} THEN 'receipt_refs' WHEN NOT {_UNIQUE.replace('{a}', 'related_refs')} THEN 'related_refs'
  ELSE {SOURCE_REASON.replace('source_ref', 'source_event_ref')} END AS invalid,
 CASE WHEN len(list_filter(receipt_refs, lambda r: NOT list_contains(given, r))) > 0 THEN 'unknown_receipt'
  WHEN len(list_filter(related_refs, lambda r: NOT list_contains(linked, r))) > 0 THEN 'unrelated_source'
  WHEN len(receipt_refs) > 0 AND len(list_filter(related_refs, lambda r: list_contains(acted, r))) = 0 THEN 'no_act' END AS refusal FROM (SELECT *, coalesce((SELECT list(d.receipt_ref) FROM delivery_heads d WHERE d.run_ref = o2.run_ref AND d.session_ref = o2.session_ref), []) AS given,
   coalesce((SELECT list(l.source_ref) FROM links l WHERE l.run_ref = o2.run_ref AND l.session_ref = o2.session_ref), []) AS linked,
   coalesce((SELECT list(l.source_ref) FROM links l WHERE l.run_ref = o2.run_ref AND l.session_ref = o2.session_ref AND l.role = 'agent_act'), []) AS acted FROM o2) o),
walked AS (SELECT x.tenant_ref AS tenant, x.session_ref AS session, x.arrival, idempotency_key AS k,
  concat_ws('|', run_ref, source_group_ref, source_event_ref, x.actor_kind, x.actor_ref, x.text, array_to_string(list_sort(receipt_refs), ','), array_to_string(list_sort(related_refs), ',')) AS h,
  concat_ws('|', x.scope_kind, x.agent_ref, x.relationship_ref, source_event_ref) AS s, concat_ws('|', x.actor_kind, x.actor_ref, x.text, x.constitution_ref, x.constitution_text) AS p,
  concat_ws('|', run_ref, source_group_ref) AS g, source_event_ref AS src, 'outcome' AS role, refusal,
  concat_ws('|', q.actor_kind, q.actor_ref, q.text, q.constitution_ref, q.constitution_text) AS old, '' AS ep, episode_ref AS fixed,
  'outcome_' || substr({hash_sql('outcome-event-identity.v1', 'x.scope_kind', 'x.tenant_ref', 'x.agent_ref', 'x.relationship_ref', 'x.session_ref', 'run_ref', 'source_group_ref', 'source_event_ref', 'idempotency_key')}, 1, 32) AS own
  FROM o3 x LEFT JOIN sources q ON q.tenant_ref = x.tenant_ref AND q.session_ref = x.session_ref AND q.source_ref = x.source_event_ref WHERE invalid IS NULL),
{_WALK}"""


@query("c02_outcome_job", sql_with(*_FEEDBACK_VIEWS, "sources", extra=_ARRAYS + ",\n" + _O2).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT k AS idempotency_key, arrival, status, e AS episode_ref, o AS outcome_ref FROM walk WHERE n > 0
UNION ALL SELECT idempotency_key, arrival, 'invalid:' || invalid, '', '' FROM o3 WHERE invalid IS NOT NULL""")
def _(t: Tables):
    asked = again(outcomes(t).drop("episode_ref").withColumn("outcome_ref", F.concat("outcome_ref", F.lit("~"), F.col("arrival"))), "receipt_refs", "_unknown")
    asked = asked.withColumn("outcome_ref", F.concat("outcome_ref", F.lit("~"), F.col("arrival")))
    return feedback.outcome_job(asked, t("delivery_heads"), t("links"), t("episodes"), t("sources")).select("idempotency_key", "arrival", "status", "episode_ref", "outcome_ref")


def delivered(t: Tables):
    return t("delivery_heads").join(t("delivery_refs"), "receipt_ref")


_CHAIN = """chain AS (SELECT DISTINCT l.episode_ref, s.version_ref, s.root_ref, s.version_number, d.receipt_ref
 FROM contexts c JOIN context_items i ON i.context_ref = c.context_ref AND i.item_kind = 'disposition'
 JOIN delivery_heads d ON d.context_ref = c.context_ref AND d.run_ref = c.run_ref
 JOIN delivery_refs r ON r.receipt_ref = d.receipt_ref AND r.memory_ref = i.memory_ref
 JOIN dispositions s ON s.version_ref = i.memory_ref AND s.status = 'active'
 JOIN links l ON l.run_ref = c.run_ref AND l.session_ref = c.session_ref AND l.role = 'situation' AND l.source_ref = i.query_source_ref)"""
_CH = sql_with(*_FEEDBACK_VIEWS, extra=_CHAIN)


def chain(t: Tables):
    return feedback.feedback_chain(t("contexts"), t("context_items"), delivered(t), t("dispositions"), t("links"))


@query("j05_feedback_chain", _CH + "SELECT * FROM chain")
def _(t: Tables):
    return chain(t).drop("tenant_ref")


@query("j06_consumed_feedback", _CH + """SELECT * FROM chain c WHERE NOT EXISTS (SELECT 1 FROM seed_basis b
 WHERE b.version_ref = c.version_ref AND b.episode_ref = c.episode_ref AND b.role IN ('reenactment', 'inhibition'))""")
def _(t: Tables):
    return feedback.open_feedback(chain(t), t("seed_basis")).drop("tenant_ref")


@query("j07_outcome_attribution", _CH + """SELECT DISTINCT c.version_ref, o.outcome_ref, o.episode_ref FROM chain c JOIN outcome_heads o ON o.episode_ref = c.episode_ref AND o.actor_kind <> 'agent'
 JOIN outcome_deliveries r ON r.outcome_ref = o.outcome_ref AND r.receipt_ref = c.receipt_ref""")
def _(t: Tables):
    return feedback.attribute_outcomes(chain(t), t("outcome_heads"), t("outcome_deliveries")).drop("tenant_ref")
