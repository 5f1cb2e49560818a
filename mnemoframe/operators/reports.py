"""Composite evaluation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.session import cut_lineage
from .evalstats import (COMPARISONS, MODES, cluster_bootstrap, cluster_stats, mode_summary, pairwise_tally,
                        question_differences)

# Stage effects (left arm, right arm, condition) that locate a bottleneck, and their names.
STAGES = (
    ("oracle_episode", "none", "source_available", "answer_model"),
    ("oracle_episode", "semantic_top40", "source_available", "retrieval"),
    ("semantic_top40", "current_core", "indexed", "selection_assembly"),
    ("current_core", "learned_core", "delivered", "consolidation"),
)


def question_checks(results: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Reason why a question cannot enter the report (NULL: it can)."""
    key = ["persona_id", "question_ref"]
    per = results.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("mode").alias("modes"),
        F.max(~F.col("mode").isin(*MODES)).alias("foreign"),
        F.max(F.col("oracle_label_used") != (F.col("mode") == "oracle_episode")).alias("leak"),
        F.max(F.col("error") != "").alias("failed"),
        F.max(F.when(F.col("mode") == "current_core", F.col("correct"))).alias("core"))
    d = diagnostics.select(*key, F.col("answer_correct").alias("__d"))
    reason = F.when((F.col("rows") != len(MODES)) | (F.col("modes") != len(MODES)) | F.col("foreign"), "incomplete").when(
        F.col("leak"), "oracle_leak").when(F.col("failed"), "failed").when(F.col("__d").isNull(), "no_diagnostic").when(
        F.col("__d") != F.col("core"), "diagnostic_mismatch")
    return per.join(d.hint("merge"), key, "left").select(*key, reason.alias("reason"))


def effects(differences: DataFrame, samples: int) -> DataFrame:
    """n, difference and interval per comparison."""
    stats = cut_lineage(cluster_stats(differences))
    point = stats.groupBy("comparison").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("difference"))
    return point.join(cluster_bootstrap(stats, samples), "comparison", "left")


def effect_differences(results: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Differences of the plain comparisons and of the stage effects on their conditioned questions."""
    flags = diagnostics.select("persona_id", "question_ref", "source_available", "indexed", "delivered")
    pairs = tuple(dict.fromkeys((*COMPARISONS, *[(a, b) for a, b, _, _ in STAGES])))
    all_of = question_differences(results, pairs).join(flags.hint("merge"), ["persona_id", "question_ref"])
    plain = [f"{a}-minus-{b}" for a, b in COMPARISONS]
    named = F.array_compact(F.array(
        F.when(F.col("comparison").isin(*plain), F.col("comparison")),
        *[F.when((F.col("comparison") == f"{a}-minus-{b}") & F.col(c), f"{a}-minus-{b}|{c}") for a, b, c, _ in STAGES]))
    return all_of.select("persona_id", "question_ref", F.explode(named).alias("comparison"), "diff")


def bottleneck(effect_rows: DataFrame) -> DataFrame:
    """Largest reliably positive gap between stages; one row."""
    names = [f"{a}-minus-{b}|{c}" for a, b, c, _ in STAGES]
    wide = effect_rows.groupBy().agg(*[
        F.max(F.when(F.col("comparison") == n, F.struct("difference", "ci_low"))).alias(f"e{i}") for i, n in enumerate(names)])
    gap = lambda i: F.col(f"e{i}.difference")
    sure = lambda i: F.coalesce((gap(i) > 0) & (F.col(f"e{i}.ci_low") > 0), F.lit(False))
    row = lambda i: F.struct(gap(i).alias("gap"), F.lit(-i).alias("o"), F.lit(STAGES[i][3]).alias("name"), F.lit(names[i]).alias("comparison"))
    later = range(1, len(STAGES))
    reliable = F.array_max(F.array_compact(F.array(*[F.when(sure(i), row(i)) for i in later])))
    measured = F.array_max(F.array_compact(F.array(*[F.when(gap(i).isNotNull(), row(i)) for i in later])))
    out = lambda name, g, comparison: F.struct(name.alias("bottleneck"), g.alias("gap"), comparison.alias("comparison"))
    none, first = F.lit(None).cast("double"), F.lit(names[0])
    chosen = F.when(gap(0).isNull(), out(F.lit("evaluation_source_coverage"), none, first)).when(
        ~sure(0), out(F.lit("answer_model"), gap(0), first)).when(
        reliable.isNotNull(), out(reliable["name"], reliable["gap"], reliable["comparison"])).when(
        measured.isNotNull(), out(F.lit("no_measured_core_bottleneck"), measured["gap"], measured["comparison"])).otherwise(
        out(F.lit("evaluation_source_coverage"), none, first))
    return wide.select(chosen.alias("c")).select("c.*")


def effect_report(results: DataFrame, diagnostics: DataFrame, samples: int = 2000) -> dict[str, DataFrame]:
    """Rejected questions, arm summaries, effects and the located bottleneck."""
    checks = cut_lineage(question_checks(results, diagnostics))
    good = checks.filter("reason IS NULL").select("persona_id", "question_ref")
    kept = results.join(good.hint("merge"), ["persona_id", "question_ref"], "left_semi")
    rows = cut_lineage(effects(effect_differences(kept, diagnostics), samples))
    return {"rejects": checks.filter("reason IS NOT NULL"), "modes": mode_summary(kept, ["pref_type"]),
            "effects": rows, "decision": bottleneck(rows)}


def arm_scores(judged: DataFrame) -> DataFrame:
    """One row per instance: the score of every arm, their difference and what was rendered."""
    score = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("score")))
    return judged.groupBy("instance_ref", "persona_id", "split", "instance_type").agg(
        score("none").alias("none"), score("recollection_only").alias("recollection_only"), score("seed_enabled").alias("seed_enabled"),
        F.max("seed_rendered").alias("seed_rendered"), F.max((F.col("arm") != "none") & F.col("rendered")).alias("any_rendered"))


def seed_report(judged: DataFrame, samples: int = 2000) -> dict[str, DataFrame]:
    """Arm means and effect by split and type, funnel, pooled interval, pass gate with reasons."""
    wide = cut_lineage(arm_scores(judged).withColumn("diff", F.col("seed_enabled") - F.col("recollection_only")))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("split", "instance_type")])
    mean = lambda c: F.sum(c) / F.count(F.lit(1))
    groups = cut_lineage(wide.withColumn("g", F.explode(fields)).groupBy("g.field", "g.value").agg(
        F.count(F.lit(1)).alias("instances"), mean("none").alias("none_mean"), mean("recollection_only").alias("recollection_mean"),
        mean("seed_enabled").alias("seed_mean"), mean("diff").alias("difference"),
        F.sum(F.signum("diff")).cast("bigint").alias("net_flips"),
        F.count_if("seed_rendered").alias("rendered"), F.count_if(F.col("diff") != 0).alias("score_changed")))
    paired = cut_lineage(effects(wide.withColumn("comparison", F.lit("seed-minus-recollection")), samples))
    failing = F.array_compact(F.array(
        F.when(F.col("difference") <= 0, F.concat(F.lit("split "), "value", F.lit(" did not improve"))),
        F.when(F.col("net_flips") <= 0, F.concat(F.lit("split "), "value", F.lit(" has no net flip"))),
        F.when(F.col("rendered") == 0, F.concat(F.lit("split "), "value", F.lit(" rendered no disposition")))))
    # splits are a handful, so their reasons fit one row
    per_split = groups.filter("field = 'split'").groupBy().agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("value", failing.alias("f")))), lambda s: s["f"])).alias("f"))
    pooled = paired.groupBy().agg(F.max("ci_low").alias("ci_low"))
    both = per_split.withColumn("one", F.lit(1)).join(pooled.withColumn("one", F.lit(1)), "one")
    reasons = F.concat("f", F.array_compact(F.array(F.when(F.col("ci_low") <= 0, "pooled interval is not positive"))))
    decision = both.select((F.size(reasons) == 0).alias("passed"), F.array_join(reasons, "; ").alias("reasons"))
    return {"groups": groups, "paired": paired, "decision": decision}


ANCHOR_STAGES = ("formed", "selected", "rendered", "behavior_changed")


def anchor_report(trajectory: DataFrame, behavior: DataFrame) -> dict[str, DataFrame]:
    """Accuracy and flips, behaviour by dimension, and the first stage that fails in any dimension.

    ``trajectory``: instance_ref, arm, correct. ``behavior``: instance_ref, dimension, arm, score, formed,
    selected, rendered.
    """
    hit = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("correct")))
    t = trajectory.groupBy("instance_ref").agg(*[hit(a).alias(a) for a in ("none", "recollection_only", "seed_enabled")])
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    accuracy = t.agg(
        share("none").alias("none"), share("recollection_only").alias("recollection_only"), share("seed_enabled").alias("seed_enabled"),
        F.count_if(~F.col("recollection_only") & F.col("seed_enabled")).alias("positive_flips"),
        F.count_if(F.col("recollection_only") & ~F.col("seed_enabled")).alias("negative_flips"))
    score = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("score")))
    b = behavior.groupBy("instance_ref", "dimension").agg(
        score("none").alias("none"), score("recollection_only").alias("rec"), score("seed_enabled").alias("seed"),
        F.max("formed").alias("formed"), F.max("selected").alias("selected"), F.max("rendered").alias("rendered"))
    b = b.withColumn("selected", F.col("formed") & F.col("selected")).withColumn("rendered", F.col("selected") & F.col("rendered"))
    b = b.withColumn("behavior_changed", F.col("rendered") & (F.col("seed") != F.col("rec"))).withColumn(
        "score_improved", F.col("behavior_changed") & (F.col("seed") > F.col("rec")))
    mean = lambda c: F.sum(c) / F.count(F.lit(1))
    dims = b.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("instances"), mean("none").alias("none_mean"), mean("rec").alias("recollection_mean"),
        mean("seed").alias("seed_mean"), (mean("seed") - mean("rec")).alias("seed_delta"),
        *[F.count_if(s).alias(s) for s in (*ANCHOR_STAGES, "score_improved")])
    every = dims.groupBy().agg(*[F.min(F.col(s) > 0).alias(s) for s in ANCHOR_STAGES], F.min(F.col("seed_delta") > 0).alias("improved"))
    joined = every.withColumn("one", F.lit(1)).join(accuracy.withColumn("one", F.lit(1)), "one")
    fine = F.col("improved") & (F.col("seed_enabled") >= F.col("recollection_only")) & (F.col("positive_flips") >= 1)
    stage = F.coalesce(*[F.when(~F.col(s), s) for s in ANCHOR_STAGES], F.when(~fine, "score_improved"))
    decision = joined.select(F.when(stage.isNull(), "holdout_ready").otherwise("bottleneck").alias("status"), stage.alias("bottleneck"))
    return {"accuracy": accuracy, "dimensions": dims, "decision": decision}


def _wins(comparison: str, side: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("comparison") == comparison, F.col(side))), F.lit(0))


def delayed_report(pairs: DataFrame, funnel: DataFrame, wins: int) -> tuple[DataFrame, DataFrame]:
    """Tally per comparison and one decision row.

    A side dominates with at least ``wins`` clear wins and none of the other side. ``funnel``: one row per
    instance with formed, selected, rendered.
    """
    tally = cut_lineage(pairwise_tally(pairs))
    wide = tally.groupBy().agg(*[
        _wins(c, s).alias(f"{c}/{s}") for c in ("oracle-anti", "oracle-rag", "learned-rag") for s in ("left_wins", "right_wins")])
    stages = funnel.groupBy().agg(*[F.count_if(s).alias(s) for s in ("formed", "selected", "rendered")])
    n = lambda c, s: F.col(f"`{c}/{s}`")
    dominates = lambda c: (n(c, "left_wins") >= wins) & (n(c, "right_wins") == 0)
    short = F.coalesce(*[F.when(F.col(s) < wins, s) for s in ("formed", "selected", "rendered")])
    out = lambda status, where: F.struct(F.lit(status).alias("status"), where.cast("string").alias("bottleneck"))
    decision = F.when(~dominates("oracle-anti"), out("manipulation_check_failed", F.lit("oracle_vs_anti"))).when(
        dominates("learned-rag") & short.isNull(), out("preliminary_learned_advantage", F.lit(None))).when(
        dominates("oracle-rag"), out("learning_or_selection_bottleneck", F.coalesce(short, F.lit("learned_effect")))).when(
        (n("oracle-rag", "left_wins") <= 2) | (n("oracle-rag", "right_wins") > 0),
        out("no_detectable_architecture_advantage", F.lit("oracle_vs_rag"))).otherwise(out("inconclusive", F.lit("oracle_vs_rag")))
    joined = wide.withColumn("one", F.lit(1)).join(stages.withColumn("one", F.lit(1)), "one")
    return tally, joined.select(decision.alias("d")).select("d.*")


def generalization_report(positive: DataFrame, negative: DataFrame, delayed_decision: DataFrame) -> DataFrame:
    """Decision over positive cases and negative controls.

    ``positive``/``negative``: active_dispositions and active_recollections per case.
    """
    p = positive.groupBy().agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("active_recollections") > 0).alias("with_recollection"))
    q = negative.groupBy().agg(F.count_if(F.col("active_dispositions") > 0).alias("false_positives"))
    one = lambda df: df.withColumn("one", F.lit(1))
    j = one(p).join(one(q), "one").join(one(delayed_decision), "one")
    status = F.when(F.col("false_positives") > 0, "negative_control_failed").when(
        F.col("with_recollection") != F.col("cases"), "recollection_coexistence_failed").when(
        F.col("status") != "preliminary_learned_advantage", "positive_generalization_failed").otherwise("preliminary_generalization")
    where = F.when(F.col("false_positives") > 0, "false_positive_formation").when(
        F.col("with_recollection") != F.col("cases"), "active_recollections").when(
        F.col("status") != "preliminary_learned_advantage", F.coalesce("bottleneck", "status"))
    return j.select("false_positives", "with_recollection", status.alias("decision"), where.alias("bottleneck"))


def companion_report(consensus: DataFrame, funnel: DataFrame, false_positives: DataFrame, cases: int, wins: int = 3) -> DataFrame:
    """Judges the learned effect only on cases where both oracle controls work.

    ``consensus``: one row per case with oracle_anti, oracle_rag, learned_rag; ``funnel`` as for the delayed report.
    """
    c = consensus.groupBy().agg(
        F.count_if((F.col("oracle_anti") == "left") & (F.col("oracle_rag") == "left")).alias("manipulable"),
        F.count_if((F.col("oracle_anti") == "left") & (F.col("oracle_rag") == "left") & (F.col("learned_rag") == "left")).alias("learned"),
        F.count_if((F.col("oracle_anti") == "left") & (F.col("oracle_rag") == "left") & (F.col("learned_rag") == "right")).alias("rag"))
    f = funnel.groupBy().agg(*[F.count_if(s).alias(s) for s in ("formed", "selected", "rendered")])
    one = lambda df: df.withColumn("one", F.lit(1))
    j = one(c).join(one(f), "one").join(one(false_positives), "one")
    short = F.coalesce(*[F.when(F.col(s) != cases, s) for s in ("formed", "selected", "rendered")])
    out = lambda status, where: F.struct(F.lit(status).alias("status"), where.cast("string").alias("bottleneck"))
    decision = F.when(F.col("false_positives") > 0, out("engineering_bottleneck", F.lit("false_positive_formation"))).when(
        short.isNotNull(), out("engineering_bottleneck", short)).when(
        F.col("manipulable") != cases, out("evaluation_ceiling", F.lit("oracle_vs_rag"))).when(
        (F.col("learned") >= wins) & (F.col("rag") == 0), out("preliminary_learned_companion_advantage", F.lit(None))).otherwise(
        out("neutral_disposition_architecture_bottleneck", F.lit("learned_effect")))
    return j.select("manipulable", "learned", "rag", decision.alias("d")).select("manipulable", "learned", "rag", "d.*")


def funnel_records(questions: DataFrame, gold: DataFrame, indexed: DataFrame, selected: DataFrame, delivered: DataFrame,
                   basis_selected: DataFrame, basis_delivered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stage flags per question: does any gold episode appear at the stage.

    ``questions`` carry source_available; every other input has the keys and ``episode_ref``.
    """
    keys = list(keys)
    g = gold.select(*keys, "episode_ref").distinct()
    stages = {"indexed": indexed, "selected": selected, "delivered": delivered,
              "learned_basis_selected": basis_selected, "learned_basis_delivered": basis_delivered}
    rows = None
    for name, df in stages.items():
        part = df.select(*keys, "episode_ref").join(g, [*keys, "episode_ref"], "left_semi").select(*keys, F.lit(name).alias("stage"))
        rows = part if rows is None else rows.unionByName(part)
    flags = rows.groupBy(*keys).agg(*[F.max(F.col("stage") == s).alias(s) for s in stages])
    out = questions.join(flags, keys, "left")
    return out.select(*questions.columns, *[
        (F.col("source_available") & F.coalesce(F.col(s), F.lit(False))).alias(s) for s in stages])


def accepted_cohort(results: DataFrame, expected: DataFrame, accepted_missing: DataFrame, diagnostics: DataFrame,
                    samples: int = 2000) -> dict[str, DataFrame]:
    """Coverage problems beyond the accepted ones, and the effect report of what is there."""
    from .quality import coverage

    key = ["persona_id", "question_ref"]
    answered = results.select(*key).distinct()
    gaps = coverage(expected, answered, key)
    surprising = gaps.join(accepted_missing.select(*key, F.lit("missing").alias("problem")), [*key, "problem"], "left_anti")
    stale = accepted_missing.select(*key).join(gaps.filter("problem = 'missing'").select(*key), key, "left_anti").withColumn(
        "problem", F.lit("accepted_but_present"))
    report = effect_report(results, diagnostics, samples)
    report["coverage"] = surprising.unionByName(stale)
    return report
