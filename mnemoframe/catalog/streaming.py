"""Streams over the driver's tables, checked against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import refs
from ..plans.bindings import Tables, sql_with
from ..plans.session import cut_lineage, shared_folder
from ..streaming import run, state, window_table
from .intake import _FIRST, _REQ_HASH, _gates
from .registry import query
from .sqltext import EPISODE_REF, GROUP


class Streams(Tables):
    """The same views over file streams."""

    def _read(self, name: str):
        return run.stream_table(self.spark, self.folder, name)


def streams(t: Tables) -> Streams:
    return Streams(t.spark, t.folder)


@query("x01_stream_admit", sql_with("requests") + f"""SELECT idempotency_key, arrival, CASE WHEN arrival = fa THEN 'new' WHEN request_hash = fh THEN 'replay' ELSE 'conflict' END AS status
 FROM ({_FIRST.replace('{src}', f'SELECT *, {_REQ_HASH} AS request_hash FROM requests')})""")
def _(t: Tables):
    hashed = streams(t)("requests").withColumn("request_hash", refs.observe_hash())
    return run.run_available(state.admit(hashed)).select("idempotency_key", "arrival", "status")


# links of the request stream; every message is the reply to the turn before it, and some come again late
_LK = """lk AS (SELECT tenant_ref, scope_kind, agent_ref, relationship_ref, session_ref, run_ref, source_group_ref, source_ref, role, arrival FROM requests WHERE run_ref <> ''
 UNION ALL SELECT tenant_ref, scope_kind, agent_ref, relationship_ref, session_ref, run_ref, source_group_ref, concat(source_ref, '-late'), CASE WHEN arrival % 3 = 0 THEN 'outcome' ELSE role END, arrival + 7000 FROM requests WHERE run_ref <> '' AND arrival % 10 = 0)"""


def link_stream(t: Tables):
    r = streams(t)("requests").filter("run_ref <> ''")
    again = F.when(F.col("arrival") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copies = r.withColumn("late", F.explode(again))
    late = F.col("late") == 1
    return copies.select(*[c.strip() for c in GROUP.split(",")],
                         F.when(late, F.concat("source_ref", F.lit("-late"))).otherwise(F.col("source_ref")).alias("source_ref"),
                         F.when(late & (F.col("arrival") % 3 == 0), "outcome").otherwise(F.col("role")).alias("role"),
                         F.when(late, F.col("arrival") + 7000).otherwise(F.col("arrival")).alias("arrival"))


@query("x02_stream_episodes", sql_with("requests", extra=_LK + "," + _gates("lk")) + f"""SELECT run_ref, source_ref, role, arrival, event, CASE WHEN event IN ('materialized', 'requeued') THEN {EPISODE_REF} ELSE '' END AS episode_ref FROM (
 SELECT *, CASE WHEN gate IS NULL OR arrival < gate THEN 'accepted' WHEN arrival = gate THEN 'materialized' WHEN first = arrival AND role = 'outcome' THEN 'requeued' WHEN first <= gate OR role = 'outcome' THEN 'accepted' ELSE 'sealed' END AS event FROM (
  SELECT *, min(arrival) OVER (PARTITION BY {GROUP}, source_ref, role) AS first FROM lk LEFT JOIN gate USING ({GROUP})))""")
def _(t: Tables):
    return run.run_available(state.episodes(link_stream(t))).select("run_ref", "source_ref", "role", "arrival", "event", "episode_ref")


@query("x07_late_outcomes", sql_with("requests", extra=_LK + "," + _gates("lk")) + f"""SELECT run_ref, source_ref, min(arrival) AS arrival, {EPISODE_REF} AS episode_ref FROM lk JOIN gate USING ({GROUP}) WHERE role = 'outcome' GROUP BY {GROUP}, source_ref, gate HAVING min(arrival) > gate""")
def _(t: Tables):
    events = run.run_available(state.episodes(link_stream(t)))
    return events.filter("event = 'requeued'").select("run_ref", "source_ref", "arrival", "episode_ref")


@query("x03_stream_pairs", sql_with("turns") + "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY user_turn) - 1 AS pair_idx, user_text, agent_text, '' AS reason FROM turns")
def _(t: Tables):
    return run.run_available(state.pairs(streams(t)("conversations")))


# The rule of one owner as a walk through its arrivals: pe pending, ta tail, cl clock, w1 to w3 the windows that a step closes.
_QUIET = 6 * 3600 * 1_000_000


_STEPS = f"""steps AS (SELECT owner, episode_ref AS ref, epoch_us(CAST(ts AS TIMESTAMP)) AS tm, row_number() OVER (PARTITION BY owner ORDER BY ts, episode_ref) AS n FROM arrivals
 UNION ALL SELECT owner, NULL, max(epoch_us(CAST(ts AS TIMESTAMP))) + 30 * {_QUIET}, count(*) + 1 FROM arrivals GROUP BY owner)"""


def _walk_windows(rows: str = _STEPS) -> str:
    def closing(cond: str, pe: str, ta: str, to: str, out: str, now: str) -> str:
        window = f"(list_concat({ta}, {pe}))[1:32]"
        return (f"CASE WHEN {cond} THEN {window} ELSE [] END AS {out}, CASE WHEN {cond} THEN {pe}[len({window}) - len({ta}) + 1:] ELSE {pe} END AS pe{to}, "
                f"CASE WHEN {cond} THEN ({window})[greatest(1, len({window}) - 3):] ELSE {ta} END AS ta{to}, {now} AS cl{to}")

    quiet = lambda k: f"len(pe{k}) > 0 AND tm > cl{k} + {_QUIET}"
    one = closing(quiet(0), "pe0", "ta0", "1", "w1", f"CASE WHEN {quiet(0)} THEN cl0 + {_QUIET} ELSE cl0 END")
    two = closing(quiet(1), "pe1", "ta1", "2", "w2", f"CASE WHEN {quiet(1)} THEN cl1 + {_QUIET} ELSE cl1 END")
    new = "ref IS NOT NULL AND NOT list_contains(pe2, ref)"
    add = f"CASE WHEN {new} THEN list_append(pe2, ref) ELSE pe2 END AS pe3, CASE WHEN {new} THEN tm ELSE cl2 END AS cl3, {new} AS came"
    three = closing("came AND len(pe3) >= 32", "pe3", "ta2", "4", "w3", "CASE WHEN came AND len(pe3) >= 32 THEN tm ELSE cl3 END")
    return rows + f""",
walk AS (SELECT DISTINCT owner, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS pe, CAST([] AS VARCHAR[]) AS ta, CAST(0 AS BIGINT) AS cl, CAST([] AS VARCHAR[]) AS w1, CAST([] AS VARCHAR[]) AS w2, CAST([] AS VARCHAR[]) AS w3 FROM steps
 UNION ALL SELECT owner, n, pe4, ta4, cl4, w1, w2, w3 FROM (SELECT owner, n, w1, w2, {three} FROM (SELECT owner, n, tm, ta2, w1, w2, {add} FROM (
  SELECT owner, n, ref, tm, w1, {two} FROM (SELECT owner, n, ref, tm, {one} FROM (
   SELECT w.owner, s.n, s.ref, s.tm, w.pe AS pe0, w.ta AS ta0, w.cl AS cl0 FROM walk w JOIN steps s ON s.owner = w.owner AND s.n = w.n + 1)))))),
shut AS (SELECT owner, n * 3 + k AS o, CASE k WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END AS w FROM (SELECT *, unnest([1, 2, 3]) AS k FROM walk)),
named AS (SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY o) - 1 AS window_no, w FROM shut WHERE len(w) > 0)"""


@query("x04_stream_windows", sql_with("arrivals", extra=_walk_windows()).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT owner, window_no, CAST(p - 1 AS BIGINT) AS position, w[p] AS episode_ref
FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM named)""")
def _(t: Tables):
    live = streams(t)("arrivals").select("owner", "episode_ref", F.col("ts").cast("timestamp").alias("ts"))
    # the stream ends with a row far behind the last one, so that every window falls quiet
    last = t("arrivals").agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).first()["ts"]
    end = live.filter(F.col("ts") == F.lit(last)).select(F.lit("~end").alias("owner"), "episode_ref", (F.col("ts") + F.expr("interval 30 days")).alias("ts"))
    return run.run_available(state.windows(live.unionByName(end), 6 * 3600)).filter("owner <> '~end'")


# four batches by time, with rows that come one or two batches after their time; those behind the watermark are late
_LATE = f"""ev AS (SELECT owner, episode_ref, epoch_us(CAST(ts AS TIMESTAMP)) AS tm, event_id FROM arrivals), ex AS (SELECT min(tm) AS lo, max(tm) AS hi FROM ev),
bt AS (SELECT e.*, least(3, CAST(floor((tm - lo) * 4.0 / (hi - lo + 1)) AS BIGINT) + CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 40 = 7 THEN 2 ELSE 0 END) AS b, CAST(floor((hi - lo) / 8) AS BIGINT) AS delay FROM ev e, ex),
mx AS (SELECT b, max(max(tm)) OVER (ORDER BY b) AS latest, any_value(delay) AS delay FROM bt GROUP BY b),
lt AS (SELECT t.*, m.latest IS NOT NULL AND t.tm < m.latest - m.delay AS late FROM bt t LEFT JOIN mx m ON m.b = t.b - 1),
steps AS (SELECT owner, ref, tm, row_number() OVER (PARTITION BY owner ORDER BY b, last, tm, ref) AS n FROM (SELECT owner, episode_ref AS ref, tm, b, 0 AS last FROM lt WHERE NOT late
 UNION ALL SELECT o.owner, NULL, CASE WHEN m.b = 3 THEN m.latest + 30 * {_QUIET} ELSE m.latest - m.delay END, m.b, 1 FROM mx m, (SELECT DISTINCT owner FROM lt WHERE NOT late) o))"""


@query("x04_late_rows", sql_with("arrivals", extra=_walk_windows(_LATE)).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT 'window' AS what, owner, window_no, CAST(p - 1 AS BIGINT) AS position, w[p] AS episode_ref FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM named)
UNION ALL SELECT 'late', owner, NULL, NULL, episode_ref FROM lt WHERE late""")
def _(t: Tables):
    rows = t("arrivals").select("owner", "episode_ref", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    lo, hi = rows.agg(F.min("micros"), F.max("micros")).first()
    behind = F.when(F.col("event_id") % 10 == 0, 1).when(F.col("event_id") % 40 == 7, 2).otherwise(0)
    number = F.least(F.lit(3), F.floor((F.col("micros") - lo) * 4.0 / (hi - lo + 1)) + behind)
    dealt = cut_lineage(rows.withColumn("b", number))
    table = window_table.WindowTable(t.spark, f"{shared_folder(t.spark)}/windows-{uuid.uuid4().hex}", _QUIET, (hi - lo) // 8)
    # the third batch comes twice
    for k in (0, 1, 2, 2, 3):
        table.apply(dealt.filter(F.col("b") == k), k, end=k == 3)
    return table.answers()
