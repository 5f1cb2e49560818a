"""Queries over windows, queues and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs
from ..operators import history, windows
from ..plans.bindings import Tables, sql_with
from ..plans.split import ranges_of, time_slices, top_n
from .registry import query
from .sqltext import hash_blob, field, list_hex

QUIET = 6 * 3600


def assigned(t: Tables):
    return windows.assign_windows(t("arrivals"), ["owner"], "ts", "event_id", time_slices("ts", 86400),
                                  quiet_seconds=QUIET)


def members(t: Tables):
    return windows.window_members(assigned(t), ["owner"], "episode_ref")


_ASSIGNED = f"""isl AS (SELECT *, row_number() OVER w AS rn, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL {QUIET} SECOND THEN 1 ELSE 0 END AS opens
  FROM arrivals WINDOW w AS (PARTITION BY owner ORDER BY ts, event_id)),
num AS (SELECT *, sum(opens) OVER (PARTITION BY owner ORDER BY rn) AS island FROM isl),
fst AS (SELECT *, min(rn) OVER (PARTITION BY owner, island) AS first_rn FROM num),
asg AS (SELECT owner, episode_ref, event_id, ts, rn, CAST(CASE WHEN rn - first_rn < 32 - least(4, first_rn - 1) THEN first_rn
   ELSE first_rn + 32 - least(4, first_rn - 1) + 28 * floor((rn - first_rn - (32 - least(4, first_rn - 1))) / 28) END AS BIGINT) AS window_start FROM fst),
mem AS (SELECT owner, window_start, rn, episode_ref, false AS is_overlap FROM asg
  UNION ALL SELECT h.owner, h.window_start, a.rn, a.episode_ref, true FROM (SELECT DISTINCT owner, window_start FROM asg) h
   JOIN asg a ON a.owner = h.owner AND a.rn BETWEEN h.window_start - 4 AND h.window_start - 1)"""
_W = sql_with("arrivals", extra=_ASSIGNED)


@query("w05_windows_by_quiet_and_size", _W + "SELECT owner, window_start, rn, episode_ref, is_overlap FROM mem")
def _(t: Tables):
    return members(t)


_OWNER_LIT = ("'relationship'", "'t0'", "'agent'", "owner")
_WIN_HASH = lambda tag, owner, sep: hash_blob(
    field(f"'{tag}'"), *[field(x) for x in owner], f"unhex({list_hex('eps')})", field(f"'{sep}'"), f"unhex({list_hex('outs')})")


@query("f04_window_hashes", sql_with("arrivals", extra=_ASSIGNED + """,
w AS (SELECT owner, window_start, list(episode_ref ORDER BY rn) AS eps, ['out-1', 'out-' || owner] AS outs FROM mem GROUP BY 1, 2)""")
       + f"""SELECT owner, window_start, len(eps) AS n, {_WIN_HASH('consolidation-window.v2', _OWNER_LIT, 'outcomes')} AS window_hash,
 {_WIN_HASH('consolidation-queue-window.v1', ("'t0'", "'relationship'", "'agent'", "owner"), 'OUTCOMES')} AS queue_hash FROM w""")
def _(t: Tables):
    w = windows.frozen_windows(members(t), ["owner"], "episode_ref").select(
        F.lit("t0").alias("tenant_ref"), F.lit("relationship").alias("scope_kind"), F.lit("agent").alias("agent_ref"),
        F.col("owner").alias("relationship_ref"), "window_start", "episode_refs",
        F.array(F.lit("out-1"), F.concat(F.lit("out-"), "owner")).alias("outs"))
    return w.select(F.col("relationship_ref").alias("owner"), "window_start", F.size("episode_refs").cast("bigint").alias("n"),
                    refs.window_hash(F.col("episode_refs"), F.col("outs")).alias("window_hash"),
                    refs.queue_hash(F.col("episode_refs"), F.col("outs")).alias("queue_hash"))


_OUT = """outs AS (SELECT CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'nobody' ELSE concat('user-', CAST(user_id AS VARCHAR)) END AS owner,
  concat('ep-', CAST(event_id AS VARCHAR)) AS episode_ref, concat('out-', CAST(event_id AS VARCHAR)) AS outcome_ref FROM events)"""


@query("w06_outcome_partition", sql_with("arrivals", extra=_ASSIGNED + "," + _OUT) + """
SELECT o.outcome_ref, m.window_start, m.is_overlap, 'placed' AS status FROM outs o JOIN mem m ON m.owner = o.owner AND m.episode_ref = o.episode_ref
UNION ALL SELECT outcome_ref, NULL, NULL, 'outside' FROM outs o WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.owner = o.owner AND m.episode_ref = o.episode_ref)""")
def _(t: Tables):
    e = t("events")
    outcomes = e.select(
        F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), "nobody").otherwise(F.concat(F.lit("user-"), "user_id")).alias("owner"),
        F.concat(F.lit("ep-"), "event_id").alias("episode_ref"), F.concat(F.lit("out-"), "event_id").alias("outcome_ref"))
    placed, outside = windows.partition_outcomes(members(t), ["owner"], outcomes)
    return placed.select("outcome_ref", "window_start", "is_overlap", F.lit("placed").alias("status")).unionByName(
        outside.select("outcome_ref", F.lit(None).cast("bigint").alias("window_start"), F.lit(None).cast("boolean").alias("is_overlap"), F.lit("outside").alias("status")))


@query("c03_window_job", sql_with("arrivals", extra=_ASSIGNED + "," + _OUT + """,
w AS (SELECT m.owner, m.window_start, list(m.episode_ref ORDER BY m.rn) AS eps FROM mem m GROUP BY 1, 2),
wo AS (SELECT m.owner, m.window_start, list(o.outcome_ref ORDER BY m.rn) AS outs FROM mem m JOIN outs o ON o.owner = m.owner AND o.episode_ref = m.episode_ref GROUP BY 1, 2)""")
       + f"""SELECT owner, window_start, array_to_string(eps, ',') AS episodes, array_to_string(outs, ',') AS outcomes, window_start = min(window_start) OVER (PARTITION BY owner) AS may_run,
 {_WIN_HASH('consolidation-queue-window.v1', ("'t0'", "'relationship'", "'agent'", "owner"), 'OUTCOMES')} AS queue_hash
 FROM (SELECT w.*, coalesce(wo.outs, []) AS outs FROM w LEFT JOIN wo USING (owner, window_start))""")
def _(t: Tables):
    e = t("events")
    outcomes = e.select(
        F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), "nobody").otherwise(F.concat(F.lit("user-"), "user_id")).alias("owner"),
        F.concat(F.lit("ep-"), "event_id").alias("episode_ref"), F.concat(F.lit("out-"), "event_id").alias("outcome_ref"))
    # one pass over the members: an episode of these data has at most one outcome
    held = members(t).join(outcomes, ["owner", "episode_ref"], "left")
    w = held.groupBy("owner", "window_start").agg(F.array_sort(F.collect_list(F.struct("rn", "episode_ref", "outcome_ref"))).alias("m"))
    first = w.groupBy("owner").agg(F.min("window_start").alias("__head"))
    eps = F.transform("m", lambda s: s["episode_ref"])
    outs = F.array_compact(F.transform("m", lambda s: s["outcome_ref"]))
    full = w.join(first, "owner").select(
        F.lit("t0").alias("tenant_ref"), F.lit("relationship").alias("scope_kind"), F.lit("agent").alias("agent_ref"),
        F.col("owner").alias("relationship_ref"), "window_start", eps.alias("eps"), outs.alias("outs"),
        (F.col("window_start") == F.col("__head")).alias("may_run"))
    return full.select(F.col("relationship_ref").alias("owner"), "window_start", F.array_join("eps", ",").alias("episodes"),
                       F.array_join("outs", ",").alias("outcomes"), "may_run",
                       refs.queue_hash(F.col("eps"), F.col("outs")).alias("queue_hash"))


@query("w07_owner_head", sql_with("jobs") + "SELECT owner, job_ref, job_order FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY job_order) AS r FROM jobs WHERE NOT completed) WHERE r = 1")
def _(t: Tables):
    return windows.head_of(t("jobs").select("owner", "job_ref", "job_order", "completed"), ["owner"], "job_order", ~F.col("completed")).drop("completed")


@query("w08_stream_head", sql_with("op_log") + "SELECT stream_ref, operation_id, arrival FROM (SELECT *, row_number() OVER (PARTITION BY stream_ref ORDER BY arrival) AS r FROM op_log WHERE NOT acknowledged) WHERE r = 1")
def _(t: Tables):
    return windows.head_of(t("op_log").select("stream_ref", "operation_id", "arrival", "acknowledged"), ["stream_ref"], "arrival", ~F.col("acknowledged")).drop("acknowledged")


@query("w09_next_sequence", sql_with("op_log") + """SELECT n.stream_ref, n.operation_id, coalesce(x.top, 0) + row_number() OVER (PARTITION BY n.stream_ref ORDER BY n.arrival) AS stream_sequence
FROM (SELECT * FROM op_log WHERE NOT acknowledged) n LEFT JOIN (SELECT stream_ref, max(arrival) AS top FROM op_log WHERE acknowledged GROUP BY 1) x USING (stream_ref)""")
def _(t: Tables):
    log = t("op_log")
    stored = log.filter("acknowledged").select("stream_ref", "operation_id", F.col("arrival").alias("stream_sequence"))
    # the log is offered twice: stored operations and second copies must be skipped
    offered = log.unionByName(log.withColumn("arrival", F.col("arrival") + 1))
    return windows.next_sequence(offered, stored, ranges_of("arrival", 4096)).select("stream_ref", "operation_id", "stream_sequence")


@query("w10_query_text", sql_with("messages") + "SELECT tenant_ref, scope_kind, relationship_ref, string_agg(trim(text), chr(10) ORDER BY arrival) AS query_text FROM messages WHERE role = 'user' GROUP BY ALL")
def _(t: Tables):
    return windows.query_text(t("messages").filter("role = 'user'"), ["tenant_ref", "scope_kind", "relationship_ref"], ["arrival"])


# one text after the other; a text takes what whole characters the bytes left allow
_CUT = """tx AS (SELECT tenant_ref, scope_kind, relationship_ref, list(trim(text) ORDER BY arrival) AS texts FROM messages WHERE role = 'user' AND trim(text) <> '' GROUP BY ALL)
SELECT tenant_ref, scope_kind, relationship_ref, list_reduce(list_prepend('', texts), lambda acc, x : CASE WHEN octet_length(encode(acc)) >= {n} THEN acc
 ELSE concat(acc, CASE WHEN acc = '' THEN '' ELSE chr(10) END, substr(x, 1, list_max(list_filter(range(0, {n} + 1), lambda i : octet_length(encode(substr(x, 1, i))) <= {n} - octet_length(encode(acc)) - CASE WHEN acc = '' THEN 0 ELSE 1 END)))) END) AS query_text FROM tx"""


@query("w10_query_text_cut", sql_with("messages", extra=_CUT.replace("{n}", "301")))
def _(t: Tables):
    return windows.query_text(t("messages").filter("role = 'user'"), ["tenant_ref", "scope_kind", "relationship_ref"], ["arrival"], max_bytes=301)


@query("a16_consolidation_receipt", sql_with("recollections") + "SELECT origin_job_ref, string_agg(version_ref, ',' ORDER BY version_ref) AS version_refs FROM recollections GROUP BY 1")
def _(t: Tables):
    return windows.consolidation_receipt(t("recollections")).select("origin_job_ref", F.array_join("version_refs", ",").alias("version_refs"))


_ST = """b AS (SELECT version_ref, list(DISTINCT role || chr(0) || episode_ref) AS s FROM recollection_basis GROUP BY 1),
tgt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_ref, scope_kind, agent_ref, relationship_ref ORDER BY version_ref) AS r FROM recollections WHERE status = 'active' {cond}) WHERE r <= 64),
st AS (SELECT tenant_ref, scope_kind, agent_ref, relationship_ref, sha256({tag} || unhex(string_agg(hex({body}), '' ORDER BY version_ref))) AS state_hash
  FROM tgt LEFT JOIN b USING (version_ref) GROUP BY ALL)"""
_BODY = " || ".join([*[field(x) for x in ("scope_kind", "tenant_ref", "agent_ref", "relationship_ref", "root_ref", "version_ref", "CAST(version_number AS VARCHAR)", "text", "application_scope")],
                     f"unhex({list_hex('list_sort(coalesce(s, []))')})"])


def _state(cond: str) -> str:
    return _ST.replace("{cond}", cond).replace("{tag}", field("'recollection-state.v1'")).replace("{body}", _BODY)


OWNER = list(refs.OWNER)


def _targets(versions):
    return top_n(versions.filter("status = 'active'"), OWNER, ["version_ref"], 64)


@query("a15_window_state_hash", sql_with("recollections", "recollection_basis", extra=_state("")) + "SELECT scope_kind, relationship_ref, state_hash FROM st")
def _(t: Tables):
    return windows.state_hash(_targets(t("recollections")), t("recollection_basis"), OWNER).select("scope_kind", "relationship_ref", "state_hash")


@query("x08_stale_guard", sql_with("recollections", "recollection_basis", extra=_state("AND home <> 7") + ", old AS (SELECT * FROM st), " + _state("").replace("b AS (", "b2 AS (").replace("tgt AS (", "tgt2 AS (").replace("FROM tgt LEFT JOIN b ", "FROM tgt2 LEFT JOIN b2 ").replace("st AS (", "st2 AS ("))
       + "SELECT o.scope_kind, o.relationship_ref, o.state_hash <> n.state_hash AS stale FROM old o JOIN st2 n USING (tenant_ref, scope_kind, agent_ref, relationship_ref)")
def _(t: Tables):
    # the old snapshot lacks the memories of one home conversation
    old = windows.state_hash(_targets(t("recollections").filter("home <> 7")), t("recollection_basis"), OWNER)
    now = windows.state_hash(_targets(t("recollections")), t("recollection_basis"), OWNER)
    return windows.stale_guard(old, now, OWNER).select("scope_kind", "relationship_ref", "stale")


@query("u05_merge_refs", sql_with("delivery_refs", extra="""d AS (SELECT receipt_ref, list(memory_ref ORDER BY memory_ref) AS e FROM delivery_refs GROUP BY 1)""") + """
SELECT receipt_ref, array_to_string(list_concat(e, list_filter(['', e[1], receipt_ref, 'x'], lambda r: r <> '' AND NOT list_contains(e, r))), ',') AS merged FROM d""")
def _(t: Tables):
    d = t("delivery_refs").groupBy("receipt_ref").agg(F.sort_array(F.collect_list("memory_ref")).alias("e"))
    added = F.array(F.lit(""), F.col("e")[0], F.col("receipt_ref"), F.lit("x"), F.lit("x"))
    return d.select("receipt_ref", F.array_join(windows.merge_refs("e", added), ",").alias("merged"))


# --- histories -----------------------------------------------------------------------------------
# the driver's conversations are clean; this view adds blanks, nulls and runs of one role
_ROUGH = """rough AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 4 AND turn = 3 THEN 'user' WHEN conv_id % 9 = 5 AND turn = 2 THEN 'assistant' ELSE role END AS role,
 CASE WHEN conv_id % 9 = 6 AND turn = 1 THEN NULL WHEN conv_id % 9 = 7 AND turn = 3 THEN NULL WHEN conv_id % 9 = 8 AND turn = 2 THEN '  ' ELSE text END AS text FROM conversations),
fst AS (SELECT conv_id, min(turn) AS f FROM rough WHERE role <> 'system' GROUP BY 1),
ev AS (SELECT conv_id, turn, role, text, lead(nxt) OVER w AS after FROM (SELECT *, 1 AS nxt FROM rough WHERE role IN ('user','assistant') AND (trim(text) <> '' OR (text IS NULL AND role = 'assistant'))) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
nx AS (SELECT e.conv_id, e.turn, e.role, e.text, (SELECT arg_min(n.text IS NULL, n.turn) FROM ev n WHERE n.conv_id = e.conv_id AND n.turn > e.turn AND n.role = 'assistant') AS void FROM ev e),
keep AS (SELECT * FROM nx WHERE NOT (role = 'user' AND coalesce(void, false)) AND text IS NOT NULL),
chg AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS c FROM keep),
runs AS (SELECT conv_id, run, min(role) AS role, min(turn) AS turn, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
  FROM (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM chg) GROUP BY 1, 2)"""


def rough(t: Tables):
    c = t("conversations")
    at = lambda m, turn: (F.col("conv_id") % 9 == m) & (F.col("turn") == turn)
    return c.select(
        "conv_id", "turn",
        F.when(at(4, 3), "user").when(at(5, 2), "assistant").otherwise(F.col("role")).alias("role"),
        F.when(at(6, 1) | at(7, 3), None).when(at(8, 2), "  ").otherwise(F.col("text")).alias("text"))


_RG = "WITH " + _ROUGH + "\n"


@query("s01_read_conversations", _RG + """SELECT conv_id, 'pair' AS kind, CAST(row_number() OVER (PARTITION BY u.conv_id ORDER BY u.run) - 1 AS BIGINT) AS pair_idx, u.text AS user_text, a.text AS agent_text
 FROM runs u JOIN runs a USING (conv_id) WHERE a.run = u.run + 1 AND u.role = 'user'
UNION ALL SELECT conv_id, 'trailing', NULL, text, '' FROM runs r WHERE role = 'user' AND run = (SELECT max(run) FROM runs x WHERE x.conv_id = r.conv_id)
UNION ALL SELECT r.conv_id, 'background', NULL, string_agg(text, chr(10) || chr(10) ORDER BY turn), '' FROM rough r LEFT JOIN fst USING (conv_id) WHERE role = 'system' AND (f IS NULL OR turn < f) GROUP BY 1
UNION ALL SELECT conv_id, 'violation', turn, 'assistant_first', '' FROM runs WHERE run = 1 AND role = 'assistant'""")
def _(t: Tables):
    parts = history.dialogue(rough(t))
    none = F.lit(None).cast("bigint").alias("pair_idx")
    row = lambda df, kind, idx, text, agent=F.lit(""): df.select("conv_id", F.lit(kind).alias("kind"), idx, F.col(text).alias("user_text"), agent.alias("agent_text"))
    return (
        row(parts["pairs"], "pair", F.col("pair_idx"), "user_text", F.col("agent_text"))
        .unionByName(row(parts["trailing"], "trailing", none, "trailing"))
        .unionByName(row(parts["background"], "background", none, "background"))
        .unionByName(row(parts["violations"], "violation", F.col("turn").alias("pair_idx"), "reason")))


@query("s02_check_alternation", _RG + """, p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, min(turn) OVER (PARTITION BY conv_id) AS f, count(*) OVER (PARTITION BY conv_id) AS n, max(turn) OVER (PARTITION BY conv_id) AS l FROM rough WHERE role <> 'system')
SELECT conv_id, turn, CASE WHEN turn <> f + rn - 1 THEN 'gap' ELSE 'role' END AS reason FROM p WHERE turn <> f + rn - 1 OR role <> CASE WHEN rn % 2 = 1 THEN 'user' ELSE 'assistant' END
UNION ALL SELECT DISTINCT conv_id, l, 'odd' FROM p WHERE n % 2 = 1""")
def _(t: Tables):
    return history.check_alternation(rough(t))


@query("s11_fixed_batches", sql_with("turns") + "SELECT run_ref, relationship_ref, CAST(floor((row_number() OVER (PARTITION BY scope_kind, relationship_ref ORDER BY arrival) - 1) / 28) AS BIGINT) AS batch FROM turns")
def _(t: Tables):
    return history.fixed_batches(t("turns"), ["scope_kind", "relationship_ref"], "arrival", ranges_of("arrival", 1 << 24)).select("run_ref", "relationship_ref", "batch")


@query("s12_session_episodes", sql_with("messages", extra="""p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, lead(source_ref) OVER (PARTITION BY conv_id ORDER BY turn) AS act, lead(source_ref, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM messages WHERE role <> 'system')""") + """
SELECT conv_id, source_ref, CAST(floor(p / 2) AS BIGINT) AS episode, 'situation' AS role FROM p WHERE p % 2 = 0 AND act IS NOT NULL
UNION ALL SELECT conv_id, act, CAST(floor(p / 2) AS BIGINT), 'agent_act' FROM p WHERE p % 2 = 0 AND act IS NOT NULL
UNION ALL SELECT conv_id, reply, CAST(floor(p / 2) AS BIGINT), 'outcome' FROM p WHERE p % 2 = 0 AND reply IS NOT NULL""")
def _(t: Tables):
    return history.session_episodes(t("messages"))


_CALLS = """calls AS (SELECT user_text AS input, CASE WHEN conv_id % 10 = 2 THEN '' ELSE agent_text END AS output FROM turns WHERE conv_id % 3 <> 0
 UNION ALL SELECT user_text, concat(agent_text, '!') FROM turns WHERE conv_id % 10 = 1)"""


@query("s07_replay_lookup", sql_with("turns", extra=_CALLS) + """SELECT sha256(r.user_text) AS input_hash, count(DISTINCT r.run_ref) * 2 AS requests,
 CASE WHEN count(DISTINCT c.output) > 1 THEN 'conflict' WHEN count(c.output) = 0 THEN 'missing' ELSE 'answered' END AS status,
 CASE WHEN count(DISTINCT c.output) = 1 THEN min(c.output) END AS output
FROM turns r LEFT JOIN (SELECT * FROM calls WHERE output <> '') c ON c.input = r.user_text GROUP BY r.user_text""")
def _(t: Tables):
    turns = t("turns")
    calls = turns.filter("conv_id % 3 <> 0").select(F.col("user_text").alias("input"), F.when(F.col("conv_id") % 10 == 2, "").otherwise(F.col("agent_text")).alias("output")).unionByName(
        turns.filter("conv_id % 10 = 1").select(F.col("user_text").alias("input"), F.concat("agent_text", F.lit("!")).alias("output")))
    asked = turns.select(F.col("user_text").alias("input"))
    return history.replay_lookup(asked.unionByName(asked), calls)  # two arms ask the same


@query("s08_export_memory_state", sql_with("recollections", "recollection_basis", "episodes") + """
SELECT scope_kind, relationship_ref, 'version' AS section, version_ref, status AS detail, sha256(text) AS item, '' AS session_ref FROM recollections
UNION ALL SELECT r.scope_kind, r.relationship_ref, 'basis', b.version_ref, b.role, b.episode_ref, e.session_ref FROM recollection_basis b JOIN recollections r USING (version_ref) JOIN episodes e USING (episode_ref)
UNION ALL SELECT DISTINCT scope_kind, relationship_ref, 'job', '', '', origin_job_ref, '' FROM recollections""")
def _(t: Tables):
    r = t("recollections")
    return history.export_state(r, t("recollection_basis"), t("episodes"), r).drop("tenant_ref", "agent_ref")


_TL = """tl AS (SELECT DISTINCT scope_kind, relationship_ref, conv_id AS place, CAST(ascii(substr(md5(CAST(conv_id AS VARCHAR)), 1, 1)) * 100 + conv_id AS BIGINT) AS date FROM messages),
pr AS (SELECT scope_kind, relationship_ref, concat('probe-', CAST(place AS VARCHAR)) AS probe_ref, CAST(ascii(substr(md5(concat('p', CAST(place AS VARCHAR))), 1, 1)) * 100 + place AS BIGINT) AS date FROM tl)"""


@query("j16_history_before", sql_with("messages", extra=_TL) + """SELECT p.scope_kind, p.relationship_ref, p.probe_ref, (SELECT max(place) FROM (SELECT place, max(date) OVER (ORDER BY place) AS high FROM tl t WHERE t.scope_kind = p.scope_kind AND t.relationship_ref = p.relationship_ref) WHERE high <= p.date) AS visible_until FROM pr p""".replace(
    "(SELECT max(place) FROM (SELECT place, max(date) OVER (ORDER BY place) AS high FROM tl t WHERE t.scope_kind = p.scope_kind AND t.relationship_ref = p.relationship_ref) WHERE high <= p.date)",
    "(SELECT max(place) FROM (SELECT *, max(date) OVER (PARTITION BY scope_kind, relationship_ref ORDER BY place) AS high FROM tl) h WHERE h.scope_kind = p.scope_kind AND h.relationship_ref = p.relationship_ref AND h.high <= p.date)"))
def _(t: Tables):
    sessions = t("messages").select("scope_kind", "relationship_ref", F.col("conv_id").alias("place")).distinct()
    dated = lambda prefix: (F.ascii(F.substring(F.md5(F.concat(F.lit(prefix), "place")), 1, 1)) * 100 + F.col("place")).cast("bigint")
    timeline = sessions.withColumn("date", dated(""))
    probes = sessions.select("scope_kind", "relationship_ref", F.concat(F.lit("probe-"), "place").alias("probe_ref"), dated("p").alias("date"))
    return history.visible_history(probes, timeline, ["scope_kind", "relationship_ref"], ranges_of("at", 4096))


# one tenant's owner is every second conversation of it, so that a bank is hot
_BANK = "concat('bank-', tenant_ref, '-', CASE WHEN conv_id % 2 = 0 THEN 'hot' ELSE CAST(conv_id % 20 AS {s}) END)"
_CUTS = f"""tl AS (SELECT {_BANK.format(s='VARCHAR')} AS bank, session_ref, conv_id * 1000 + turn AS spot, turn, (ascii(substr(md5(session_ref), 1, 1)) * 100 + conv_id) AS date FROM messages),
pr AS (SELECT bank, session_ref, concat('probe-', session_ref, '-', CAST(turn AS VARCHAR)) AS probe_ref, spot, turn, date FROM tl WHERE turn > 0),
hi AS (SELECT *, max(date) OVER (PARTITION BY bank ORDER BY spot) AS high FROM tl)"""


@query("j16_history_cuts", sql_with("messages", extra=_CUTS) + """SELECT p.probe_ref, 'turn' AS cut, (SELECT max(h.spot) FROM hi h WHERE h.bank = p.bank AND h.spot < p.spot) AS visible_until FROM pr p
UNION ALL SELECT p.probe_ref, 'session', (SELECT max(h.spot) FROM hi h WHERE h.bank = p.bank AND h.spot < p.spot - p.turn) FROM pr p
UNION ALL SELECT p.probe_ref, 'date', (SELECT max(h.spot) FROM hi h WHERE h.bank = p.bank AND h.high <= p.date) FROM pr p""")
def _(t: Tables):
    bank = F.expr(_BANK.format(s="STRING"))
    date = (F.ascii(F.substring(F.md5("session_ref"), 1, 1)) * 100 + F.col("conv_id")).cast("bigint")
    line = t("messages").select(bank.alias("bank"), "session_ref", (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "turn", date.alias("date"))
    probes = line.filter("turn > 0").withColumn("probe_ref", F.concat(F.lit("probe-"), "session_ref", F.lit("-"), F.col("turn").cast("string")))
    return history.history_cuts(probes, line, ["bank"])


_PROBE = """tg AS (SELECT concat('probe-', CAST(conv_id AS VARCHAR)) AS probe_ref, conv_id, user_turn AS target_turn, sha256(CASE WHEN conv_id % 13 = 4 THEN concat(user_text, '~') ELSE user_text END) AS target_hash FROM turns WHERE user_turn IN (2, 3)),
cite AS (SELECT probe_ref, conv_id, target_turn - 2 AS evidence_turn FROM tg UNION ALL SELECT probe_ref, conv_id, target_turn + CASE WHEN conv_id % 4 = 1 THEN 1 WHEN conv_id % 4 = 2 THEN -2 WHEN conv_id % 4 = 3 THEN 90 ELSE -1 END FROM tg)"""


@query("j17_evidence_precedes_target", sql_with("turns", extra=_PROBE) + """SELECT DISTINCT c.probe_ref, c.evidence_turn, CASE WHEN m.turn IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'not_before' END AS reason
 FROM (SELECT *, count(*) OVER (PARTITION BY probe_ref, evidence_turn) AS n FROM cite) c JOIN tg USING (probe_ref) LEFT JOIN conversations m ON m.conv_id = c.conv_id AND m.turn = c.evidence_turn
 WHERE m.turn IS NULL OR n > 1 OR c.evidence_turn >= tg.target_turn
UNION ALL SELECT tg.probe_ref, target_turn, 'target_changed' FROM tg JOIN conversations m ON m.conv_id = tg.conv_id AND m.turn = tg.target_turn WHERE sha256(m.text) <> target_hash""")
def _(t: Tables):
    c = F.col("conv_id")
    targets = t("turns").filter("user_turn IN (2, 3)").select(
        F.concat(F.lit("probe-"), "conv_id").alias("probe_ref"), "conv_id", F.col("user_turn").alias("target_turn"),
        F.sha2(F.when(c % 13 == 4, F.concat("user_text", F.lit("~"))).otherwise(F.col("user_text")), 256).alias("target_hash"))
    shift = F.when(c % 4 == 1, 1).when(c % 4 == 2, -2).when(c % 4 == 3, 90).otherwise(-1)
    cited = targets.select("probe_ref", "conv_id", F.explode(F.array(F.col("target_turn") - 2, F.col("target_turn") + shift)).alias("evidence_turn"))
    return history.evidence_violations(cited, targets, t("messages"))


_EVERY = """tg AS (SELECT concat('probe-', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS probe_ref, conv_id, turn AS target_turn, conv_id + turn AS k, sha256(CASE WHEN (conv_id + turn) % 13 = 4 THEN concat(text, '~') ELSE text END) AS target_hash FROM conversations),
cite AS (SELECT probe_ref, conv_id, target_turn - 2 AS evidence_turn FROM tg UNION ALL SELECT probe_ref, conv_id, target_turn + CASE k % 4 WHEN 1 THEN 1 WHEN 2 THEN -2 WHEN 3 THEN 90 ELSE -1 END FROM tg)"""


@query("j17_evidence_of_every_turn", "WITH " + _EVERY + """ SELECT c.probe_ref, c.evidence_turn, CASE WHEN m.turn IS NULL THEN 'missing' WHEN c.n > 1 THEN 'duplicate' ELSE 'not_before' END AS reason
 FROM (SELECT probe_ref, conv_id, evidence_turn, count(*) AS n FROM cite GROUP BY ALL) c JOIN tg USING (probe_ref) LEFT JOIN conversations m ON m.conv_id = c.conv_id AND m.turn = c.evidence_turn
 WHERE m.turn IS NULL OR c.n > 1 OR c.evidence_turn >= tg.target_turn
UNION ALL SELECT tg.probe_ref, target_turn, 'target_changed' FROM tg JOIN conversations m ON m.conv_id = tg.conv_id AND m.turn = tg.target_turn WHERE sha256(m.text) <> target_hash""")
def _(t: Tables):
    m = t("conversations").select("conv_id", "turn", "text")
    k = F.col("conv_id") + F.col("turn")
    targets = m.select(
        F.concat(F.lit("probe-"), "conv_id", F.lit("-"), "turn").alias("probe_ref"), "conv_id", F.col("turn").alias("target_turn"), k.alias("k"),
        F.sha2(F.when(k % 13 == 4, F.concat("text", F.lit("~"))).otherwise(F.col("text")), 256).alias("target_hash"))
    shift = F.when(F.col("k") % 4 == 1, 1).when(F.col("k") % 4 == 2, -2).when(F.col("k") % 4 == 3, 90).otherwise(-1)
    cited = targets.select("probe_ref", "conv_id", F.explode(F.array(F.col("target_turn") - 2, F.col("target_turn") + shift)).alias("evidence_turn"))
    return history.evidence_violations(cited, targets, m)
