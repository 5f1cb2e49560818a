"""Queries over evaluation statistics, reports, samples and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers
from ..operators import evalstats as ev, quality, reports, sampling
from ..operators.intake import SCOPE
from ..plans.bindings import Tables, sql_with
from .registry import query

SAMPLES = 200


def fingerprint(*parts):
    """First hex digit of an md5, as the views use it."""
    return F.substring(F.md5(F.concat(*parts)), 1, 1)


_SUMMARY = """SELECT mode, g.field AS field, g.value AS value, count(*) AS n, count_if(correct) AS correct,
 CASE WHEN count_if(error <> '') = 0 THEN count_if(correct) / count(*) END AS accuracy, count_if(predicted_option = '') AS invalid_answers,
 count_if(error <> '') AS errors, sum(memory_tokens) / count(*) AS mean_memory_tokens
FROM (SELECT *, unnest([{'field': '', 'value': ''}, {'field': 'pref_type', 'value': pref_type}, {'field': 'who', 'value': who}]) AS g FROM results) GROUP BY ALL"""


@query("a05_mode_summary", sql_with("results") + _SUMMARY)
def _(t: Tables):
    return ev.mode_summary(t("results"), ["pref_type", "who"])


_DIFF = """df AS (SELECT persona_id, question_ref, c.name AS comparison, max(CASE WHEN mode = c.l THEN CAST(correct AS INT) END) - max(CASE WHEN mode = c.r THEN CAST(correct AS INT) END) AS diff
 FROM (SELECT *, unnest([{'name': 'oracle_episode-minus-none', 'l': 'oracle_episode', 'r': 'none'}, {'name': 'full_history-minus-none', 'l': 'full_history', 'r': 'none'},
  {'name': 'semantic_top40-minus-oracle_episode', 'l': 'semantic_top40', 'r': 'oracle_episode'}, {'name': 'current_core-minus-semantic_top40', 'l': 'current_core', 'r': 'semantic_top40'},
  {'name': 'learned_core-minus-current_core', 'l': 'learned_core', 'r': 'current_core'}, {'name': 'oracle_episode-minus-semantic_top40', 'l': 'oracle_episode', 'r': 'semantic_top40'},
  {'name': 'semantic_top40-minus-current_core', 'l': 'semantic_top40', 'r': 'current_core'}, {'name': 'current_core-minus-learned_core', 'l': 'current_core', 'r': 'learned_core'}]) AS c FROM {src}) GROUP BY 1, 2, 3)"""
PLAIN = "('oracle_episode-minus-none', 'full_history-minus-none', 'semantic_top40-minus-oracle_episode', 'current_core-minus-semantic_top40', 'learned_core-minus-current_core')"


def _diff(src: str = "results") -> str:
    return _DIFF.replace("{src}", src)


def _boot(stats: str, name: str = "boot") -> str:
    """Interval CTEs over a CTE (comparison, persona_id, s, n)."""
    return f"""{name}_x AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY md5(persona_id)) - 1 AS idx, count(*) OVER (PARTITION BY comparison) AS k FROM {stats}),
{name}_d AS (SELECT comparison, b, j, CAST('0x' || substr(md5('0:' || b || ':' || j), 1, 15) AS BIGINT) % k AS idx FROM (SELECT comparison, k, b, unnest(range(0, k)) AS j FROM (SELECT DISTINCT comparison, k, unnest(range(0, {SAMPLES})) AS b FROM {name}_x))),
{name}_m AS (SELECT d.comparison, d.b, sum(x.s) / sum(x.n) AS m FROM {name}_d d JOIN {name}_x x ON x.comparison = d.comparison AND x.idx = d.idx GROUP BY 1, 2),
{name} AS (SELECT comparison, round(max(CASE WHEN i = {int(SAMPLES * 0.025)} THEN m END), 9) AS ci_low, round(max(CASE WHEN i = {int(SAMPLES * 0.975)} THEN m END), 9) AS ci_high
  FROM (SELECT comparison, m, row_number() OVER (PARTITION BY comparison ORDER BY m) - 1 AS i FROM {name}_m) GROUP BY 1)"""


def differences(t: Tables):
    return ev.question_differences(t("results"))


@query("a06_paired_difference", sql_with("results", extra=_diff()) + f"SELECT comparison, count(*) AS n, sum(diff) / count(*) AS difference FROM df WHERE comparison IN {PLAIN} GROUP BY 1")
def _(t: Tables):
    return ev.paired_difference(differences(t))


_STATS = f"st AS (SELECT comparison, persona_id, sum(diff) AS s, count(*) AS n FROM df WHERE comparison IN {PLAIN} GROUP BY 1, 2)"


@query("a07_cluster_bootstrap", sql_with("results", extra=_diff() + "," + _STATS + "," + _boot("st")) + "SELECT * FROM boot")
def _(t: Tables):
    return ev.cluster_bootstrap(ev.cluster_stats(differences(t)), SAMPLES)


@query("a07_poisson_bootstrap", sql_with("results", extra=_diff() + "," + _STATS + f""",
w AS (SELECT comparison, b, s, n, list_sum(list_transform([{', '.join(map(str, ev.POISSON_1))}], lambda p: CASE WHEN u >= p THEN 1 ELSE 0 END)) AS w FROM (
  SELECT comparison, s, n, b, CAST('0x' || substr(md5('0:' || b || ':' || persona_id), 1, 15) AS BIGINT) / 1152921504606846976.0::DOUBLE AS u FROM (SELECT *, unnest(range(0, {SAMPLES})) AS b FROM st))),
m AS (SELECT comparison, b, sum(w * s) / nullif(sum(w * n), 0) AS m FROM w GROUP BY 1, 2)""") + f"""SELECT comparison, round(max(CASE WHEN i = {int(SAMPLES * 0.025)} THEN m END), 9) AS ci_low, round(max(CASE WHEN i = {int(SAMPLES * 0.975)} THEN m END), 9) AS ci_high
 FROM (SELECT comparison, m, row_number() OVER (PARTITION BY comparison ORDER BY m) - 1 AS i FROM m WHERE m IS NOT NULL) GROUP BY 1""")
def _(t: Tables):
    return ev.poisson_bootstrap(ev.cluster_stats(differences(t)), SAMPLES)


# draws have no SQL; the interval must hold the point estimate, which is exact
@query("a07_tree_bootstrap", sql_with("results", extra=_diff() + "," + _STATS) + "SELECT comparison, count(*) AS personas, round(sum(s) / sum(n), 9) AS difference, true AS held, true AS apart FROM st GROUP BY 1")
def _(t: Tables):
    stats = ev.cluster_stats(differences(t))
    point = stats.groupBy("comparison").agg(F.count(F.lit(1)).alias("personas"), F.round(F.sum("s") / F.sum("n"), 9).alias("difference"))
    return point.join(ev.tree_bootstrap(stats, 400), "comparison").select(
        "comparison", "personas", "difference", F.col("difference").between(F.col("ci_low"), F.col("ci_high")).alias("held"), (F.col("ci_low") < F.col("ci_high")).alias("apart"))


@query("a08_persona_weighted", sql_with("results", extra=_diff() + "," + _STATS + ", pw AS (SELECT comparison, persona_id, s / n AS s, 1 AS n FROM st)," + _boot("pw")) + "SELECT comparison, round(avg(s), 9) AS difference, min(ci_low) AS ci_low, min(ci_high) AS ci_high FROM pw JOIN boot USING (comparison) GROUP BY 1")
def _(t: Tables):
    pw = ev.persona_weighted(ev.cluster_stats(differences(t)))
    point = pw.groupBy("comparison").agg(F.round(F.avg("s"), 9).alias("difference"))
    return point.join(ev.cluster_bootstrap(pw, SAMPLES), "comparison")


_COND = """dfs AS (SELECT d.persona_id, d.question_ref, d.diff, unnest(list_filter([CASE WHEN comparison IN ('oracle_episode-minus-none', 'oracle_episode-minus-semantic_top40') AND g.source_available THEN comparison || '|source_available' END,
  CASE WHEN comparison = 'semantic_top40-minus-current_core' AND g.indexed THEN comparison || '|indexed' END, CASE WHEN comparison = 'current_core-minus-learned_core' AND g.delivered THEN comparison || '|delivered' END{plain}], lambda x: x IS NOT NULL)) AS comparison
 FROM df d JOIN diagnostics g USING (persona_id, question_ref)),
st AS (SELECT comparison, persona_id, sum(diff) AS s, count(*) AS n FROM dfs GROUP BY 1, 2)"""


@query("a09_conditioned_difference", sql_with("results", "diagnostics", extra=_diff() + "," + _COND.replace("{plain}", "") + "," + _boot("st")) + "SELECT comparison, sum(n) AS n, sum(s) / sum(n) AS difference, min(ci_low) AS ci_low, min(ci_high) AS ci_high FROM st JOIN boot USING (comparison) GROUP BY 1")
def _(t: Tables):
    conditioned = reports.effect_differences(t("results"), t("diagnostics")).filter(F.contains("comparison", F.lit("|")))
    return reports.effects(conditioned, SAMPLES)


_RATES = ", ".join(
    f"count_if(answer_correct AND {s}) / nullif(count_if({s}), 0) AS accuracy_given_{s}, count_if(answer_correct AND NOT {s}) / nullif(count_if(NOT {s}), 0) AS accuracy_without_{s}, count_if({s}) AS n_{s}"
    for s in ev.FUNNEL)


@query("a10_funnel_summary", sql_with("diagnostics") + f"""SELECT count(*) AS questions, count_if(answer_correct) AS answer_correct, {_RATES}, count_if(indexed AND source_available) / nullif(count_if(source_available), 0) AS indexed_given_source,
 count_if(selected AND indexed) / nullif(count_if(indexed), 0) AS selected_given_indexed, count_if(delivered AND selected) / nullif(count_if(selected), 0) AS delivered_given_selected, count_if(answer_correct) / count(*) AS accuracy FROM diagnostics""")
def _(t: Tables):
    return ev.funnel_summary(t("diagnostics"))


@query("a10_funnel_violations", sql_with("diagnostics") + """SELECT persona_id, question_ref, CASE WHEN delivered AND NOT selected THEN 'delivered_not_selected' WHEN selected AND NOT indexed THEN 'selected_not_indexed'
 WHEN learned_basis_delivered AND NOT learned_basis_selected THEN 'basis_delivered_not_selected' ELSE 'unavailable_advanced' END AS reason FROM diagnostics
 WHERE (delivered AND NOT selected) OR (selected AND NOT indexed) OR (learned_basis_delivered AND NOT learned_basis_selected) OR (NOT source_available AND (indexed OR selected OR delivered OR learned_basis_selected))""")
def _(t: Tables):
    return ev.funnel_violations(t("diagnostics"))


_TRIALS = """tr AS (SELECT arm, concat('case-', CAST(doc_id % 50 AS VARCHAR)) AS case_ref, CASE WHEN f < '9' OR doc_id % 50 < 20 THEN 'formed' WHEN f < 'd' THEN 'no_change' ELSE 'malformed' END AS state,
 CASE WHEN doc_id % 50 < 10 THEN 'same' WHEN f < '9' OR doc_id % 50 < 20 THEN f END AS text FROM (SELECT doc_id, arm, substr(md5(concat(arm, CAST(doc_id AS VARCHAR))), 1, 1) AS f FROM (SELECT doc_id, unnest(['unified', 'focused']) AS arm FROM labels)))"""


@query("a11_ablation_summary", "WITH " + _TRIALS + """ SELECT arm, count(*) AS cases, sum(formed) AS formed, sum(no_change) AS no_change, sum(malformed) AS malformed, count_if(ns = 1) AS stable_state, count_if(nt = 1) AS stable_text FROM (
 SELECT arm, case_ref, count_if(state = 'formed') AS formed, count_if(state = 'no_change') AS no_change, count_if(state = 'malformed') AS malformed, count(DISTINCT state) AS ns, count(DISTINCT coalesce(text, '~')) AS nt FROM tr GROUP BY 1, 2) GROUP BY 1""")
def _(t: Tables):
    raw = t("labels").select("doc_id", F.explode(F.array(F.lit("unified"), F.lit("focused"))).alias("arm")).withColumn("f", fingerprint("arm", F.col("doc_id").cast("string")))
    case = F.col("doc_id") % 50
    formed = (F.col("f") < "9") | (case < 20)
    trials = raw.select("arm", F.concat(F.lit("case-"), case).alias("case_ref"),
                        F.when(formed, "formed").when(F.col("f") < "d", "no_change").otherwise("malformed").alias("state"),
                        F.when(case < 10, "same").when(formed, F.col("f")).alias("text"))
    return ev.ablation_summary(trials)


_CONSENSUS = """CASE WHEN w1 = w2 THEN w1 ELSE 'inconsistent' END"""
_PAIRW = f"""con AS (SELECT probe_ref, comparison, {_CONSENSUS} AS winner FROM (SELECT *, CASE forward_token WHEN 'A' THEN 'left' WHEN 'B' THEN 'right' ELSE 'tie' END AS w1, CASE reverse_token WHEN 'A' THEN 'right' WHEN 'B' THEN 'left' ELSE 'tie' END AS w2 FROM pairwise))"""


@query("a12_pairwise_tally", sql_with("pairwise", extra=_PAIRW) + "SELECT comparison, count_if(winner = 'left') AS left_wins, count_if(winner = 'right') AS right_wins, count_if(winner = 'tie') AS tie, count_if(winner = 'inconsistent') AS inconsistent FROM con GROUP BY 1")
def _(t: Tables):
    return ev.pairwise_tally(t("pairwise"))


@query("f15_pair_consensus", sql_with("pairwise", extra=_PAIRW) + "SELECT probe_ref, comparison, winner FROM con")
def _(t: Tables):
    return t("pairwise").select("probe_ref", "comparison", answers.pair_consensus("forward_token", "reverse_token").alias("winner"))


@query("f14_answer_parsers", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'A' WHEN lang = 'fr' THEN NULL ELSE upper(substr(lang, 1, 1)) END AS option, CASE WHEN doc_id % 4 < 3 THEN doc_id % 4 END AS behavior,
 CASE doc_id % 4 WHEN 0 THEN 'TIE' WHEN 1 THEN 'A' END AS pairwise, CASE WHEN doc_id % 3 = 2 THEN NULL WHEN doc_id % 12 BETWEEN 1 AND 10 THEN doc_id % 12 END AS judge FROM documents""")
def _(t: Tables):
    d = F.col("doc_id")
    option = F.when(F.col("lang") == "en", " a\n").when(F.col("lang") == "fr", "fr").otherwise(F.substring("lang", 1, 1))
    pairwise = F.when(d % 4 == 0, "tie ").when(d % 4 == 1, "a").otherwise("both")
    judge = F.concat(F.lit("text\n### Evaluation Score\n**"), (d % 12).cast("string"), F.lit("/10** - fine\nmore"),
                     F.when(d % 3 == 2, "\n### **Evaluation Score**\n3").otherwise(""))
    return t("documents").select(
        "doc_id", answers.option_letter(option).alias("option"), answers.behavior_score((d % 4).cast("string")).cast("bigint").alias("behavior"),
        answers.pairwise_token(pairwise).alias("pairwise"), answers.judge_score(judge).cast("bigint").alias("judge"))


@query("a14_latency_tokens", """SELECT event_type AS operation, count(*) AS calls, CAST(sum(event_id % 500) AS BIGINT) AS tokens, sum(event_id % 500) / count(*) AS mean_tokens, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def _(t: Tables):
    log = t("events").select(F.col("event_type").alias("operation"), F.col("value").alias("duration"), (F.col("event_id") % 500).alias("tokens"))
    return ev.latency_tokens(log, F.floor(F.col("duration")).cast("bigint"))


_HM = """hm AS (SELECT concat('harness-', source) AS harness, mode, concat(' ', CASE WHEN h < 'a' THEN lang ELSE 'x' END, chr(10)) AS output, lang AS expected, CASE WHEN h = 'f' THEN 'boom' ELSE '' END AS error
 FROM (SELECT source, lang, mode, substr(md5(concat(mode, CAST(doc_id AS VARCHAR))), 1, 1) AS h FROM (SELECT *, unnest(['none', 'core']) AS mode FROM documents)))"""


@query("a17_harness_matrix", "WITH " + _HM + """ SELECT harness, mode, count_if(error = '') AS answered, count_if(error <> '') AS errors, count_if(error = '' AND trim(output, E' \\n') = expected) AS exact, count_if(error = '' AND trim(output, E' \\n') = expected) / nullif(count_if(error = ''), 0) AS exact_rate FROM hm GROUP BY 1, 2""")
def _(t: Tables):
    raw = t("documents").select("doc_id", "source", "lang", F.explode(F.array(F.lit("none"), F.lit("core"))).alias("mode")).withColumn("h", fingerprint("mode", F.col("doc_id").cast("string")))
    return ev.harness_matrix(raw.select(
        F.concat(F.lit("harness-"), "source").alias("harness"), "mode",
        F.concat(F.lit(" "), F.when(F.col("h") < "a", F.col("lang")).otherwise("x"), F.lit("\n")).alias("output"),
        F.col("lang").alias("expected"), F.when(F.col("h") == "f", "boom").otherwise("").alias("error")))


# each disposition that a context showed is a case, by how far its chain went
_LC = """f AS (SELECT version_ref, bool_or(role = 'formation') AS formed, bool_or(role = 'reenactment') AS again, bool_or(role = 'inhibition') AS held FROM seed_basis GROUP BY 1),
shown AS (SELECT i.memory_ref, bool_or(t.agent_text <> '') AS expressed FROM context_items i JOIN contexts c ON c.context_ref = i.context_ref JOIN turns t ON t.run_ref = c.run_ref AND t.session_ref = c.session_ref WHERE i.item_kind = 'disposition' GROUP BY 1),
told AS (SELECT r.memory_ref, bool_or(o.receipt_ref IS NOT NULL) AS answered FROM delivery_refs r LEFT JOIN (SELECT DISTINCT receipt_ref FROM outcome_deliveries) o ON o.receipt_ref = r.receipt_ref GROUP BY 1),
one AS (SELECT CASE WHEN told.memory_ref IS NULL THEN 'no_delivery' WHEN NOT answered THEN 'no_outcome' WHEN coalesce(held, false) THEN 'negative_complete' ELSE 'positive_complete' END AS kind,
 coalesce(formed, false) AS formed, true AS rendered, expressed, coalesce(again, false) AS reenacted, coalesce(held, false) AS changed, s.status = 'superseded' AS future_changed
 FROM dispositions s JOIN shown ON shown.memory_ref = s.version_ref LEFT JOIN f ON f.version_ref = s.version_ref LEFT JOIN told ON told.memory_ref = s.version_ref),
g AS (SELECT kind, bool_or(formed) AS formed, bool_or(rendered) AS rendered, bool_or(expressed) AS expressed, bool_or(reenacted) AS reenacted, bool_or(changed) AS changed, bool_or(future_changed) AS future_changed FROM one GROUP BY 1)"""


def _lifecycle_sql() -> str:
    flag = lambda kind, f: f"(SELECT {f} FROM g WHERE kind = '{kind}')"
    said = ["CASE WHEN (SELECT count(*) FROM g) <> 4 THEN 'all four lifecycle cases are required' END"]
    for kind in ("positive_complete", "no_delivery", "no_outcome", "negative_complete"):
        said += [f"CASE WHEN NOT {flag(kind, f)} THEN '{kind} did not prove {f}' END" for f in ("formed", "rendered", "expressed")]
    said += [f"CASE WHEN NOT {flag('positive_complete', 'reenacted')} THEN 'positive complete chain did not reenact' END",
             f"CASE WHEN {flag('no_delivery', 'reenacted')} OR {flag('no_delivery', 'changed')} THEN 'undelivered control changed the disposition' END",
             f"CASE WHEN {flag('no_outcome', 'changed')} THEN 'control without outcome changed the disposition' END",
             f"CASE WHEN NOT ({flag('negative_complete', 'changed')} AND {flag('negative_complete', 'future_changed')}) THEN 'negative complete chain did not change selection' END"]
    return f"SELECT len(r) = 0 AS passed, coalesce(array_to_string(r, '; '), '') AS reasons FROM (SELECT list_filter([{', '.join(said)}], lambda x: x IS NOT NULL) AS r)"


@query("a18_lifecycle_summary", sql_with("dispositions", "seed_basis", "context_items", "contexts", "turns", "delivery_refs", "outcome_deliveries", extra=_LC) + _lifecycle_sql())
def _(t: Tables):
    basis = t("seed_basis").groupBy("version_ref").agg(*[F.max(F.col("role") == r).alias(n) for r, n in (("formation", "formed"), ("reenactment", "again"), ("inhibition", "held"))])
    runs = t("contexts").select("context_ref", "run_ref", "session_ref").join(t("turns").select("run_ref", "session_ref", "agent_text"), ["run_ref", "session_ref"])
    shown = t("context_items").filter("item_kind = 'disposition'").join(runs, "context_ref").groupBy(F.col("memory_ref").alias("version_ref")).agg(F.max(F.col("agent_text") != "").alias("expressed"))
    answered = t("outcome_deliveries").select("receipt_ref").distinct().withColumn("answer", F.lit(True))
    told = t("delivery_refs").join(answered, "receipt_ref", "left").groupBy(F.col("memory_ref").alias("version_ref")).agg(F.max(F.coalesce("answer", F.lit(False))).alias("answered"))
    one = t("dispositions").join(shown, "version_ref").join(basis, "version_ref", "left").join(told, "version_ref", "left").na.fill(False, ["formed", "again", "held"])
    kind = F.when(F.col("answered").isNull(), "no_delivery").when(~F.col("answered"), "no_outcome").when(F.col("held"), "negative_complete").otherwise("positive_complete")
    flags = {"formed": F.col("formed"), "rendered": F.lit(True), "expressed": F.col("expressed"), "reenacted": F.col("again"), "changed": F.col("held"), "future_changed": F.col("status") == "superseded"}
    return ev.lifecycle_summary(one.groupBy(kind.alias("kind")).agg(*[F.max(v).alias(k) for k, v in flags.items()]))


_OC = """e AS (SELECT owner, count(DISTINCT episode_ref) AS episodes FROM arrivals GROUP BY 1),
j AS (SELECT owner, count(*) AS jobs, count_if(NOT completed) AS pending_jobs FROM jobs GROUP BY 1),
c AS (SELECT owner, count(DISTINCT episode_ref) AS consolidated FROM arrivals WHERE event_id % 4 <> 1 OR owner < 'user-2' GROUP BY 1),
o AS (SELECT replace(stream_ref, 'stream', 'user') AS owner, count_if(NOT acknowledged AND action = 'DELETE') AS pending_ops FROM op_log GROUP BY 1)"""


@query("a02_owner_counters", sql_with("arrivals", "jobs", "op_log", extra=_OC) + """SELECT *, pending_jobs = 0 AND pending_ops = 0 AND consolidated = episodes AS ready FROM (
 SELECT e.owner, e.episodes, coalesce(j.jobs, 0) AS jobs, coalesce(j.pending_jobs, 0) AS pending_jobs, coalesce(c.consolidated, 0) AS consolidated, coalesce(o.pending_ops, 0) AS pending_ops FROM e LEFT JOIN j USING (owner) LEFT JOIN c USING (owner) LEFT JOIN o USING (owner))""")
def _(t: Tables):
    a = t("arrivals")
    seen = a.filter("event_id % 4 <> 1 OR owner < 'user-2'")
    ops = t("op_log").select(F.replace("stream_ref", F.lit("stream"), F.lit("user")).alias("owner"), (F.col("acknowledged") | (F.col("action") != "DELETE")).alias("done"))
    return ev.owner_counters(a, t("jobs").withColumn("done", F.col("completed")), seen.unionByName(seen), ops)


_CHECKS = """ck AS (SELECT persona_id, question_ref, CASE WHEN count(*) <> 6 OR count(DISTINCT mode) <> 6 THEN 'incomplete' WHEN bool_or(oracle_label_used <> (mode = 'oracle_episode')) THEN 'oracle_leak' WHEN bool_or(error <> '') THEN 'failed'
  WHEN min(d.answer_correct) IS NULL THEN 'no_diagnostic' WHEN min(d.answer_correct) <> bool_or(correct AND mode = 'current_core') THEN 'diagnostic_mismatch' END AS reason FROM results LEFT JOIN diagnostics d USING (persona_id, question_ref) GROUP BY 1, 2),
good AS (SELECT r.* FROM results r JOIN ck USING (persona_id, question_ref) WHERE ck.reason IS NULL)"""
_PL = f", CASE WHEN comparison IN {PLAIN} THEN comparison END"
_EFFECT = sql_with("results", "diagnostics", extra=_CHECKS + "," + _diff("good") + "," + _COND.replace("{plain}", _PL) + "," + _boot("st") + """,
eff AS (SELECT comparison, sum(n) AS n, sum(s) / sum(n) AS difference, min(ci_low) AS ci_low, min(ci_high) AS ci_high FROM st JOIN boot USING (comparison) GROUP BY 1)""")


@query("c12_effect_rejects", sql_with("results", "diagnostics", extra=_CHECKS) + "SELECT persona_id, question_ref, reason FROM ck WHERE reason IS NOT NULL")
def _(t: Tables):
    return reports.question_checks(t("results"), t("diagnostics")).filter("reason IS NOT NULL")


@query("c12_effect_report", _EFFECT + "SELECT * FROM eff")
def _(t: Tables):
    return reports.effect_report(t("results"), t("diagnostics"), SAMPLES)["effects"]


@query("c12_effect_decision", _EFFECT + """SELECT CASE WHEN a.difference <= 0 OR a.ci_low <= 0 THEN 'answer_model' WHEN r.comparison IS NOT NULL THEN r.name ELSE 'no_measured_core_bottleneck' END AS bottleneck,
 CASE WHEN a.difference <= 0 OR a.ci_low <= 0 THEN a.difference WHEN r.comparison IS NOT NULL THEN r.difference ELSE m.difference END AS gap,
 CASE WHEN a.difference <= 0 OR a.ci_low <= 0 THEN a.comparison WHEN r.comparison IS NOT NULL THEN r.comparison ELSE m.comparison END AS comparison
FROM (SELECT * FROM eff WHERE comparison = 'oracle_episode-minus-none|source_available') a
LEFT JOIN (SELECT *, CASE WHEN comparison LIKE 'oracle%' THEN 'retrieval' WHEN comparison LIKE 'semantic%' THEN 'selection_assembly' ELSE 'consolidation' END AS name FROM eff WHERE comparison LIKE '%|%' AND comparison <> 'oracle_episode-minus-none|source_available' AND difference > 0 AND ci_low > 0 ORDER BY difference DESC LIMIT 1) r ON true
LEFT JOIN (SELECT * FROM eff WHERE comparison LIKE '%|%' AND comparison <> 'oracle_episode-minus-none|source_available' ORDER BY difference DESC LIMIT 1) m ON true""")
def _(t: Tables):
    return reports.effect_report(t("results"), t("diagnostics"), SAMPLES)["decision"]


_WIDE = """wd AS (SELECT *, seed_enabled - recollection_only AS diff FROM (SELECT instance_ref, persona_id, split, instance_type, max(CASE WHEN arm = 'none' THEN score END) AS none, max(CASE WHEN arm = 'recollection_only' THEN score END) AS recollection_only,
  max(CASE WHEN arm = 'seed_enabled' THEN score END) AS seed_enabled, bool_or(seed_rendered) AS seed_rendered FROM judged GROUP BY 1, 2, 3, 4)),
gr AS (SELECT g.field AS field, g.value AS value, count(*) AS instances, sum(none) / count(*) AS none_mean, sum(recollection_only) / count(*) AS recollection_mean, sum(seed_enabled) / count(*) AS seed_mean, sum(diff) / count(*) AS difference,
  CAST(sum(sign(diff)) AS BIGINT) AS net_flips, count_if(seed_rendered) AS rendered, count_if(diff <> 0) AS score_changed FROM (SELECT *, unnest([{'field': 'split', 'value': split}, {'field': 'instance_type', 'value': instance_type}]) AS g FROM wd) GROUP BY 1, 2),
st AS (SELECT 'seed-minus-recollection' AS comparison, persona_id, sum(diff) AS s, count(*) AS n FROM wd GROUP BY 2)"""


@query("c13_seed_report", sql_with("judged", extra=_WIDE) + "SELECT * FROM gr")
def _(t: Tables):
    return reports.seed_report(t("judged"), SAMPLES)["groups"]


@query("c13_seed_decision", sql_with("judged", extra=_WIDE + "," + _boot("st") + """, rs AS (SELECT value, 1 AS o, 'split ' || value || ' did not improve' AS r FROM gr WHERE field = 'split' AND difference <= 0 UNION ALL SELECT value, 2, 'split ' || value || ' has no net flip' FROM gr WHERE field = 'split' AND net_flips <= 0
 UNION ALL SELECT value, 3, 'split ' || value || ' rendered no disposition' FROM gr WHERE field = 'split' AND rendered = 0 UNION ALL SELECT '~', 4, 'pooled interval is not positive' FROM boot WHERE ci_low <= 0)""") + "SELECT count(*) = 0 AS passed, coalesce(string_agg(r, '; ' ORDER BY value, o), '') AS reasons FROM rs")
def _(t: Tables):
    return reports.seed_report(t("judged"), SAMPLES)["decision"]


def anchor(t: Tables):
    j = t("judged")
    trajectory = j.select("instance_ref", "arm", (F.col("score") % 4 == F.length("instance_ref") % 4).alias("correct"))
    behavior = j.select("instance_ref", F.col("instance_type").alias("dimension"), "arm", (F.col("score") % 3).alias("score"),
                        (F.length("persona_id") > 8).alias("formed"), F.col("rendered").alias("selected"), F.col("seed_rendered").alias("rendered"))
    return reports.anchor_report(trajectory, behavior)


_ANCHOR = """tj AS (SELECT instance_ref, bool_or(arm = 'none' AND ok) AS none, bool_or(arm = 'recollection_only' AND ok) AS rec, bool_or(arm = 'seed_enabled' AND ok) AS seed FROM (SELECT *, score % 4 = length(instance_ref) % 4 AS ok FROM judged) GROUP BY 1),
bh AS (SELECT *, rendered AND seed <> rec AS behavior_changed, rendered AND seed > rec AS score_improved FROM (SELECT instance_ref, dimension, none, rec, seed, formed, formed AND selected AS selected, formed AND selected AND rendered AS rendered FROM (
 SELECT instance_ref, instance_type AS dimension, max(CASE WHEN arm = 'none' THEN score % 3 END) AS none, max(CASE WHEN arm = 'recollection_only' THEN score % 3 END) AS rec, max(CASE WHEN arm = 'seed_enabled' THEN score % 3 END) AS seed,
  bool_or(length(persona_id) > 8) AS formed, bool_or(rendered) AS selected, bool_or(seed_rendered) AS rendered FROM judged GROUP BY 1, 2))),
dm AS (SELECT dimension, count(*) AS instances, sum(none) / count(*) AS none_mean, sum(rec) / count(*) AS recollection_mean, sum(seed) / count(*) AS seed_mean, sum(seed) / count(*) - sum(rec) / count(*) AS seed_delta,
  count_if(formed) AS formed, count_if(selected) AS selected, count_if(rendered) AS rendered, count_if(behavior_changed) AS behavior_changed, count_if(score_improved) AS score_improved FROM bh GROUP BY 1)"""


@query("c14_anchor_accuracy", sql_with("judged", extra=_ANCHOR) + "SELECT count_if(none) / count(*) AS none, count_if(rec) / count(*) AS recollection_only, count_if(seed) / count(*) AS seed_enabled, count_if(NOT rec AND seed) AS positive_flips, count_if(rec AND NOT seed) AS negative_flips FROM tj")
def _(t: Tables):
    return anchor(t)["accuracy"]


@query("c14_anchor_dimensions", sql_with("judged", extra=_ANCHOR) + "SELECT * FROM dm")
def _(t: Tables):
    return anchor(t)["dimensions"]


@query("c14_anchor_decision", sql_with("judged", extra=_ANCHOR) + """SELECT CASE WHEN b IS NULL THEN 'holdout_ready' ELSE 'bottleneck' END AS status, b AS bottleneck FROM (
 SELECT CASE WHEN min(formed) = 0 THEN 'formed' WHEN min(selected) = 0 THEN 'selected' WHEN min(rendered) = 0 THEN 'rendered' WHEN min(behavior_changed) = 0 THEN 'behavior_changed'
  WHEN min(seed_delta) <= 0 OR (SELECT count_if(seed) < count_if(rec) OR count_if(NOT rec AND seed) < 1 FROM tj) THEN 'score_improved' END AS b FROM dm)""")
def _(t: Tables):
    return anchor(t)["decision"]


def delayed_inputs(t: Tables):
    funnel = t("judged").filter("arm = 'seed_enabled'").select((F.length("persona_id") > 8).alias("formed"), F.col("rendered").alias("selected"), F.col("seed_rendered").alias("rendered"))
    return t("pairwise"), funnel


_DEL = _PAIRW + """,
tl AS (SELECT comparison, count_if(winner = 'left') AS l, count_if(winner = 'right') AS r FROM con GROUP BY 1),
fn AS (SELECT count_if(length(persona_id) > 8) AS formed, count_if(rendered) AS selected, count_if(seed_rendered) AS rendered FROM judged WHERE arm = 'seed_enabled'),
w AS (SELECT max(CASE WHEN comparison = 'oracle-anti' THEN l END) AS oal, max(CASE WHEN comparison = 'oracle-anti' THEN r END) AS oar, max(CASE WHEN comparison = 'oracle-rag' THEN l END) AS orl, max(CASE WHEN comparison = 'oracle-rag' THEN r END) AS orr,
  max(CASE WHEN comparison = 'learned-rag' THEN l END) AS lrl, max(CASE WHEN comparison = 'learned-rag' THEN r END) AS lrr FROM tl)"""


@query("c15_delayed_report", sql_with("pairwise", "judged", extra=_DEL) + """SELECT CASE WHEN NOT (coalesce(oal, 0) >= 3 AND coalesce(oar, 0) = 0) THEN 'manipulation_check_failed' WHEN lrl >= 3 AND lrr = 0 AND formed >= 3 AND selected >= 3 AND rendered >= 3 THEN 'preliminary_learned_advantage'
 WHEN orl >= 3 AND orr = 0 THEN 'learning_or_selection_bottleneck' WHEN orl <= 2 OR orr > 0 THEN 'no_detectable_architecture_advantage' ELSE 'inconclusive' END AS status,
 CASE WHEN NOT (coalesce(oal, 0) >= 3 AND coalesce(oar, 0) = 0) THEN 'oracle_vs_anti' WHEN lrl >= 3 AND lrr = 0 AND formed >= 3 AND selected >= 3 AND rendered >= 3 THEN NULL
 WHEN orl >= 3 AND orr = 0 THEN CASE WHEN formed < 3 THEN 'formed' WHEN selected < 3 THEN 'selected' WHEN rendered < 3 THEN 'rendered' ELSE 'learned_effect' END ELSE 'oracle_vs_rag' END AS bottleneck FROM w, fn""".replace("coalesce(oal, 0) >= 3 AND coalesce(oar, 0) = 0", "(SELECT count(*) FROM con WHERE comparison = 'anti-rag' AND winner = 'left' AND length(probe_ref) > 7) >= 3"))
def _(t: Tables):
    pairs, funnel = delayed_inputs(t)
    # the clear anti-rag wins of longer probe names stand for the manipulation check
    check = pairs.filter("comparison = 'anti-rag' AND length(probe_ref) > 7").withColumn("comparison", F.lit("oracle-anti")).withColumn(
        "w", answers.pair_consensus("forward_token", "reverse_token")).filter("w = 'left'").drop("w")
    return reports.delayed_report(pairs.unionByName(check), funnel, 3)[1]


@query("c15_generalization_report", sql_with("judged") + """SELECT (SELECT count_if(seed_rendered) FROM judged WHERE split = 'holdout' AND arm = 'seed_enabled') AS false_positives, (SELECT count_if(rendered) FROM judged WHERE split = 'dev' AND arm = 'recollection_only') AS with_recollection,
 'negative_control_failed' AS decision, 'false_positive_formation' AS bottleneck""")
def _(t: Tables):
    j = t("judged")
    cases = j.select("split", "arm", F.col("seed_rendered").cast("int").alias("active_dispositions"), F.col("rendered").cast("int").alias("active_recollections"))
    pairs, funnel = delayed_inputs(t)
    return reports.generalization_report(cases.filter("split = 'dev' AND arm = 'recollection_only'"), cases.filter("split = 'holdout' AND arm = 'seed_enabled'"),
                                         reports.delayed_report(pairs, funnel, 3)[1])


@query("c15_companion_report", sql_with("pairwise", extra=_PAIRW) + """SELECT count_if(m) AS manipulable, count_if(m AND l = 'left') AS learned, count_if(m AND l = 'right') AS rag, 'engineering_bottleneck' AS status, 'formed' AS bottleneck FROM (
 SELECT probe_ref, bool_or(comparison = 'anti-rag' AND winner = 'left') AND bool_or(comparison = 'oracle-rag' AND winner = 'left') AS m, max(CASE WHEN comparison = 'learned-rag' THEN winner END) AS l FROM con GROUP BY 1)""")
def _(t: Tables):
    con = t("pairwise").withColumn("w", answers.pair_consensus("forward_token", "reverse_token")).groupBy("probe_ref").agg(
        *[F.max(F.when(F.col("comparison") == c, F.col("w"))).alias(n) for c, n in (("anti-rag", "oracle_anti"), ("oracle-rag", "oracle_rag"), ("learned-rag", "learned_rag"))])
    _, funnel = delayed_inputs(t)
    none = t("pairwise").groupBy().agg(F.count_if(F.col("probe_ref") == "").alias("false_positives"))
    return reports.companion_report(con, funnel, none, cases=10 ** 9)


_FR = """qs AS (SELECT run_ref, conv_id % 8 <> 5 AS source_available FROM selects),
gold AS (SELECT run_ref, episode_ref FROM turns),
ix AS (SELECT run_ref, ref AS episode_ref FROM index_hits WHERE kind = 'EPISODE'),
se AS (SELECT run_ref, ref AS episode_ref FROM index_hits WHERE kind = 'EPISODE' AND position < 8),
de AS (SELECT run_ref, ref AS episode_ref FROM index_hits WHERE kind = 'EPISODE' AND position < 4),
ba AS (SELECT c.run_ref, b.episode_ref FROM contexts c JOIN context_items i USING (context_ref) JOIN seed_basis b ON b.version_ref = i.memory_ref)"""


def _hit(src: str) -> str:
    return f"source_available AND EXISTS (SELECT 1 FROM {src} x JOIN gold g ON g.run_ref = x.run_ref AND g.episode_ref = x.episode_ref WHERE x.run_ref = qs.run_ref)"


@query("c16_funnel_records", sql_with("selects", "turns", "index_hits", "contexts", "context_items", "seed_basis", extra=_FR) + f"""SELECT run_ref, source_available, {_hit('ix')} AS indexed, {_hit('se')} AS selected, {_hit('de')} AS delivered, {_hit('ba')} AS learned_basis_selected, {_hit('ba')} AS learned_basis_delivered FROM qs""")
def _(t: Tables):
    q = t("selects").select("run_ref", (F.col("conv_id") % 8 != 5).alias("source_available"))
    hits = t("index_hits").filter("kind = 'EPISODE'").select("run_ref", F.col("ref").alias("episode_ref"), "position")
    basis = t("contexts").select("tenant_ref", "context_ref", "run_ref").join(t("context_items"), ["tenant_ref", "context_ref"]).join(
        t("seed_basis").select("tenant_ref", F.col("version_ref").alias("memory_ref"), "episode_ref"), ["tenant_ref", "memory_ref"])
    return reports.funnel_records(q, t("turns"), hits, hits.filter("position < 8"), hits.filter("position < 4"), basis, basis, ["run_ref"])


_COV = """ex AS (SELECT DISTINCT persona_id, question_ref FROM results WHERE length(question_ref) % 7 <> 5 OR persona_id = 'persona-3'), ac AS (SELECT DISTINCT persona_id, question_ref FROM results WHERE persona_id <> 'persona-7'),
am AS (SELECT DISTINCT persona_id, question_ref FROM results WHERE persona_id IN ('persona-7', 'persona-8') AND length(question_ref) = 6)"""


@query("c17_accepted_cohort", sql_with("results", extra=_COV) + """SELECT persona_id, question_ref, 'missing' AS problem FROM (SELECT * FROM ex EXCEPT SELECT * FROM ac) WHERE (persona_id, question_ref) NOT IN (SELECT (persona_id, question_ref) FROM am)
UNION ALL SELECT persona_id, question_ref, 'unexpected' FROM (SELECT * FROM ac EXCEPT SELECT * FROM ex)
UNION ALL SELECT persona_id, question_ref, 'accepted_but_present' FROM am WHERE (persona_id, question_ref) NOT IN (SELECT (persona_id, question_ref) FROM (SELECT * FROM ex EXCEPT SELECT * FROM ac))""")
def _(t: Tables):
    r = t("results")
    expected = r.filter("length(question_ref) % 7 <> 5 OR persona_id = 'persona-3'")
    accepted = r.filter("persona_id IN ('persona-7', 'persona-8') AND length(question_ref) = 6").select("persona_id", "question_ref").distinct()
    return reports.accepted_cohort(r.filter("persona_id <> 'persona-7'"), expected, accepted, t("diagnostics"), SAMPLES)["coverage"]


# --- samples and splits ----------------------------------------------------------------------------
_SHA = "sha256({} || ':' || {})"


@query("t12_hash_sample", sql_with("diagnostics") + """SELECT persona_id, question_ref, rank FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY sha256('7:' || question_ref)) AS rank FROM diagnostics
 WHERE persona_id IN (SELECT persona_id FROM (SELECT DISTINCT persona_id FROM diagnostics) ORDER BY sha256('7:' || persona_id) LIMIT 12)) WHERE rank <= 5""")
def _(t: Tables):
    return sampling.hash_sample(t("diagnostics").select("persona_id", "question_ref"), 12, 5, 7)[0].select("persona_id", "question_ref", "rank")


@query("t13_persona_split", sql_with("diagnostics") + """SELECT persona_id, CASE WHEN ex THEN 'dev' WHEN i <= greatest(10 - n, 0) THEN 'dev' WHEN i <= greatest(10 - n, 0) + 15 THEN 'H1' ELSE 'H2' END AS split FROM (
 SELECT *, row_number() OVER (PARTITION BY ex ORDER BY sha256('salt:' || persona_id)) AS i, count_if(ex) OVER () AS n FROM (SELECT DISTINCT persona_id, persona_id IN ('persona-1', 'persona-2', 'persona-33') AS ex FROM diagnostics))""")
def _(t: Tables):
    p = t("diagnostics").select("persona_id")
    return sampling.persona_split(p, p.filter("persona_id IN ('persona-1', 'persona-2', 'persona-33')"), "salt", 10, 15)


@query("t14_arm_order", sql_with("diagnostics") + """SELECT persona_id, question_ref, arm, CAST(row_number() OVER (PARTITION BY persona_id, question_ref ORDER BY sha256('arms-v1:' || persona_id || ':' || question_ref || ':' || arm)) - 1 AS BIGINT) AS place
FROM (SELECT persona_id, question_ref, unnest(['none', 'full_history', 'oracle_episode', 'semantic_top40', 'current_core', 'learned_core']) AS arm FROM diagnostics)""")
def _(t: Tables):
    return sampling.arm_order(t("diagnostics"), ["persona_id", "question_ref"], ev.MODES, "arms-v1").withColumn("place", F.col("place").cast("bigint"))


# --- quality -----------------------------------------------------------------------------------------
@query("p09_leak_check", sql_with("turns") + """SELECT run_ref, 'answer' AS secret_kind FROM turns WHERE contains(CASE WHEN conv_id % 4 = 0 THEN concat(user_text, ' ', agent_text) ELSE user_text END, agent_text)
UNION ALL SELECT run_ref, 'word' FROM turns WHERE contains(CASE WHEN conv_id % 4 = 0 THEN concat(user_text, ' ', agent_text) ELSE user_text END, substr(agent_text, 1, 4))""")
def _(t: Tables):
    turns = t("turns")
    inputs = turns.select("run_ref", F.when(F.col("conv_id") % 4 == 0, F.concat("user_text", F.lit(" "), "agent_text")).otherwise(F.col("user_text")).alias("input"))
    secrets = turns.select("run_ref", F.explode(F.array(
        F.struct(F.lit("answer").alias("secret_kind"), F.col("agent_text").alias("secret")),
        F.struct(F.lit("word").alias("secret_kind"), F.substring("agent_text", 1, 4).alias("secret")))).alias("s")).select("run_ref", "s.*")
    return quality.leak_check(inputs, secrets, "run_ref")


@query("p09_oracle_leaks", sql_with("results") + "SELECT persona_id, question_ref, mode FROM results WHERE (CASE WHEN predicted_option = '' THEN NOT oracle_label_used ELSE oracle_label_used END) <> (mode = 'oracle_episode')")
def _(t: Tables):
    flipped = t("results").withColumn("oracle_label_used", F.when(F.col("predicted_option") == "", ~F.col("oracle_label_used")).otherwise(F.col("oracle_label_used")))
    return quality.oracle_leaks(flipped)


@query("j13_orphan_checks", sql_with("links", "sources", "episodes", "seed_basis", "dispositions", "outcome_heads", "outcome_deliveries", "delivery_heads", "context_items", "recollections") + """
SELECT 'link_source' AS "check", l.source_ref AS item FROM links l WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.session_ref = l.session_ref AND s.source_ref = l.source_ref AND length(s.text) % 9 <> 4)
UNION ALL SELECT 'basis_version', b.version_ref FROM seed_basis b WHERE NOT EXISTS (SELECT 1 FROM dispositions d WHERE d.version_ref = b.version_ref AND d.status = 'active')
UNION ALL SELECT 'outcome_receipt', o.outcome_ref FROM outcome_deliveries o WHERE NOT EXISTS (SELECT 1 FROM delivery_heads d WHERE d.receipt_ref = o.receipt_ref)
UNION ALL SELECT 'item_memory', i.memory_ref FROM context_items i WHERE i.item_kind = 'recollection' AND NOT EXISTS (SELECT 1 FROM recollections r WHERE r.version_ref = i.memory_ref AND r.status = 'active')""")
def _(t: Tables):
    return quality.orphan_checks([
        ("link_source", t("links"), t("sources").filter("length(text) % 9 <> 4"), [*SCOPE, "source_ref"], "source_ref"),
        ("basis_version", t("seed_basis"), t("dispositions").filter("status = 'active'"), ["tenant_ref", "version_ref"], "version_ref"),
        ("outcome_receipt", t("outcome_deliveries"), t("delivery_heads"), ["receipt_ref"], "outcome_ref"),
        ("item_memory", t("context_items").filter("item_kind = 'recollection'"), t("recollections").filter("status = 'active'").withColumnRenamed("version_ref", "memory_ref"), ["tenant_ref", "memory_ref"], "memory_ref"),
    ])


@query("u06_coverage", sql_with("results", extra=_COV) + """SELECT persona_id, question_ref, 'missing' AS problem FROM (SELECT * FROM ex EXCEPT SELECT * FROM ac) UNION ALL SELECT persona_id, question_ref, 'unexpected' FROM (SELECT * FROM ac EXCEPT SELECT * FROM ex)
UNION ALL SELECT persona_id, question_ref, 'duplicate' FROM (SELECT * FROM ex INTERSECT SELECT * FROM ac) WHERE persona_id = 'persona-9'""")
def _(t: Tables):
    one = t("results").filter("mode = 'none'")
    actual = one.filter("persona_id <> 'persona-7'")
    return quality.coverage(one.filter("length(question_ref) % 7 <> 5 OR persona_id = 'persona-3'"), actual.unionByName(actual.filter("persona_id = 'persona-9'")), ["persona_id", "question_ref"])


@query("u04_basis_delta", sql_with("seed_basis") + """SELECT regexp_replace(version_ref, '@[^@]*$', '') AS ref, episode_ref, role, 'added' AS change FROM seed_basis WHERE role IN ('reenactment', 'inhibition') AND length(episode_ref) % 3 <> 0 AND length(version_ref) % 2 = 0
UNION ALL SELECT regexp_replace(version_ref, '@[^@]*$', ''), episode_ref, role, 'removed' FROM seed_basis WHERE role IN ('reenactment', 'inhibition') AND length(episode_ref) % 3 = 0 AND length(version_ref) % 2 = 1""")
def _(t: Tables):
    b = t("seed_basis")
    before = b.filter("length(episode_ref) % 3 = 0 OR length(version_ref) % 2 = 1")
    after = b.filter("length(episode_ref) % 3 <> 0 OR length(version_ref) % 2 = 0").withColumn("version_ref", F.regexp_replace("version_ref", "@[^@]*$", "@9"))
    return quality.basis_delta(before, after, ["reenactment", "inhibition"], lineage=True)


@query("u08_snapshot_unchanged", sql_with("recollections") + "SELECT scope_kind, relationship_ref, NOT bool_or(created_order % 41 = 3) AS unchanged FROM recollections GROUP BY 1, 2")
def _(t: Tables):
    r = t("recollections")
    changed = r.withColumn("status", F.when(F.col("created_order") % 41 == 3, "ineligible").otherwise(F.col("status")))
    return quality.snapshot_unchanged(r, changed, ["scope_kind", "relationship_ref"], ["version_ref", "status", "text"])


@query("u09_single_history", sql_with("results") + "SELECT persona_id FROM (SELECT persona_id, CASE WHEN length(question_ref) % 4 = 1 AND persona_id < 'persona-2' THEN 'b' ELSE 'a' END AS h FROM results) GROUP BY 1 HAVING count(DISTINCT h) > 1")
def _(t: Tables):
    return quality.single_history(t("results").select("persona_id", F.when((F.length("question_ref") % 4 == 1) & (F.col("persona_id") < "persona-2"), "b").otherwise("a").alias("history")))
