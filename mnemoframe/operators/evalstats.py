"""Evaluation statistics."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.answers import pair_consensus
from ..functions.text import trimmed
from ..plans.split import number_rows, running_sum, spread


def recall_at_k(rankings: DataFrame, gold: DataFrame, question: Sequence[str], ks: Sequence[int],
                asked: DataFrame | None = None, same: Sequence[str] = ()) -> DataFrame:
    """Mean share of gold items within the first k, and the share of questions with any, for several k.

    ``gold``: question, ref, each pair once. With ``asked`` (question and the class columns ``same``, each question once) ``gold`` holds ``same`` and
    ref, and the gold items of a question are those of its class: they are counted by class and only ranked items are looked up, so
    that no question is paired with all its gold items.
    """
    question, same = list(question), list(same)
    hits = [F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks]
    ranks = rankings.select(*question, "ref", "rank")
    if asked is None:
        per_question = gold.join(ranks, [*question, "ref"], "left").groupBy(*question).agg(F.count(F.lit(1)).alias("n"), *hits)
    else:
        sizes = gold.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
        of_class = asked.select(*question, *[c for c in same if c not in question])
        found = ranks.join(of_class, question).join(gold.select(*same, "ref"), [*same, "ref"], "left_semi").groupBy(*question).agg(*hits)
        per_question = of_class.join(sizes, same).join(found, question, "left").na.fill(0, [f"h{k}" for k in ks])
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])
    return per_question.select("n", F.explode(rows).alias("r")).groupBy("r.k").agg(
        F.count(F.lit(1)).alias("questions"), F.avg(F.col("r.hits") / F.col("n")).alias("recall"),
        F.avg((F.col("r.hits") > 0).cast("int")).alias("hit_rate"))


MODES = ("none", "full_history", "oracle_episode", "semantic_top40", "current_core", "learned_core")
COMPARISONS = (
    ("oracle_episode", "none"), ("full_history", "none"), ("semantic_top40", "oracle_episode"),
    ("current_core", "semantic_top40"), ("learned_core", "current_core"))


def mode_summary(results: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """n, correct, accuracy, invalid answers, errors and mean tokens per mode, overall and per metadata value.

    Metadata is unpivoted, so all groupings come from one aggregation. Accuracy is NULL where a mode has errors.
    """
    fields = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("value")),
                     *[F.struct(F.lit(g).alias("field"), F.col(g).alias("value")) for g in groups])
    rows = results.withColumn("g", F.explode(fields)).select("*", "g.field", "g.value")
    return rows.groupBy("mode", "field", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("correct"),
        F.when(F.count_if(F.col("error") != "") == 0, F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"),
        F.count_if(F.col("predicted_option") == "").alias("invalid_answers"),
        F.count_if(F.col("error") != "").alias("errors"),
        (F.sum("memory_tokens") / F.count(F.lit(1))).alias("mean_memory_tokens"))


def question_differences(results: DataFrame, comparisons: Sequence[tuple[str, str]] = COMPARISONS,
                         value: str = "correct", question: str = "question_ref", arm: str = "mode") -> DataFrame:
    """One row per question and comparison: value of the left arm minus the right arm."""
    names = sorted({m for pair in comparisons for m in pair})
    wide = results.filter(F.col(arm).isin(*names)).groupBy("persona_id", question).agg(
        *[F.max(F.when(F.col(arm) == m, F.col(value).cast("bigint"))).alias(m) for m in names])
    rows = F.array(*[F.struct(F.lit(f"{a}-minus-{b}").alias("comparison"), (F.col(a) - F.col(b)).alias("diff"))
                     for a, b in comparisons])
    return wide.select("persona_id", question, F.explode(rows).alias("r")).select(
        "persona_id", question, "r.comparison", "r.diff").filter("diff IS NOT NULL")


def cluster_stats(differences: DataFrame) -> DataFrame:
    """Sum and count per comparison and persona."""
    return differences.groupBy("comparison", "persona_id").agg(F.sum("diff").alias("s"), F.count(F.lit(1)).alias("n"))


def paired_difference(differences: DataFrame) -> DataFrame:
    """Question-weighted mean difference per comparison."""
    return differences.groupBy("comparison").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("diff") / F.count(F.lit(1))).alias("difference"))


#: Draws that are made from one row.
_DRAWS = 16384


def _draw(*parts) -> Column:
    """Integer below 16**15 from the md5 digits of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def _interval(means: DataFrame, digits: int) -> DataFrame:
    """Interval by picking sorted elements (no interpolation) of the means that each comparison has."""
    n = F.count(F.lit(1)).over(W.partitionBy("comparison"))
    ranked = means.withColumn("i", F.row_number().over(W.partitionBy("comparison").orderBy("m")) - 1).withColumn("n", n)
    at = lambda share: F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    return ranked.groupBy("comparison").agg(
        F.round(F.max(F.when(F.col("i") == at(0.025), F.col("m"))), digits).alias("ci_low"),
        F.round(F.max(F.when(F.col("i") == at(0.975), F.col("m"))), digits).alias("ci_high"))


def cluster_bootstrap(stats: DataFrame, samples: int = 2000, seed: int = 0, digits: int = 9) -> DataFrame:
    """95 % interval of the weighted mean when whole personas are resampled with replacement.

    Personas are numbered in hash order, blocked by the hash's first digits. The j-th draw of sample b takes
    number ``md5(seed:b:j) mod k``: repeatable on any partitioning, and the same for all comparisons of k personas, so it is made
    once for each k. Samples are spread in ranges of draws before the draws are made. Only statistics are hashed for the join: Spark
    cannot see how many draws a sample stands for and would broadcast them. Only ``samples`` means per comparison are sorted.
    """
    keyed = stats.withColumn("__h", F.md5("persona_id"))
    numbered = number_rows(keyed, ["comparison"], ["__h", "persona_id"],
                           F.conv(F.substring("__h", 1, 3), 16, 10).cast("bigint"), "idx")
    sizes = stats.groupBy("comparison").agg(F.count(F.lit(1)).alias("k"))
    numbered = numbered.join(sizes, "comparison").select("comparison", "s", "n", "k", (F.col("idx") - 1).alias("idx"))
    each = sizes.select("k").distinct().select("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b")).select(
        "k", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1, F.lit(_DRAWS))).alias("lo"))
    draws = spread(each, "k", "b", "lo").select("k", "b", F.explode(F.sequence("lo", F.least(F.col("lo") + _DRAWS, F.col("k")) - 1)).alias("j"))
    draws = draws.select("k", "b", (_draw(F.lit(str(seed)), "b", "j") % F.col("k")).alias("idx"))
    means = draws.join(numbered.hint("shuffle_hash"), ["k", "idx"]).groupBy("comparison", "b").agg(
        (F.sum("s") / F.sum("n")).alias("m"))
    return _interval(means, digits)


# Cumulative probabilities of Poisson(1), rounded to 15 decimals, up to the first that is 1.
POISSON_1 = tuple(round(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)), 15) for k in range(18))


def poisson_bootstrap(stats: DataFrame, samples: int = 2000, seed: int = 0, digits: int = 9) -> DataFrame:
    """The same interval with independent Poisson(1) weights, for more personas than draws can number.

    Every (persona, sample) gets its weight from a hash; sums by sample combine before the shuffle, so each
    task sends at most ``samples`` rows per comparison.
    """
    rows = stats.select("comparison", "persona_id", "s", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b"))
    u = _draw(F.lit(str(seed)), "b", "persona_id") / F.lit(float(16 ** 15))
    weight = F.lit(len(POISSON_1))
    for k in reversed(range(len(POISSON_1))):
        weight = F.when(u < POISSON_1[k], k).otherwise(weight)
    means = rows.withColumn("w", weight).groupBy("comparison", "b").agg(
        (F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    return _interval(means.filter("m IS NOT NULL"), digits)


def _node_draws(*name) -> np.random.Generator:
    """The random numbers of one node, the same in every task."""
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.sha256(repr(name).encode()).digest()[:16], "little")))


def block_counts(name: str, k: int, number: int, size: int, samples: int, seed: int = 0) -> np.ndarray:
    """How many of the ``k`` draws of each sample fall on the members of one block of ``size`` numbers.

    The draws are split down a binary tree of blocks: of the draws of a node, those of its left half are binomial. A node's random numbers
    come from its name, so any two tasks split it alike and no task sees more of the tree than the way to its own block.
    """
    lo, hi = 0, -(-k // size)
    here = np.full(samples, k, dtype=np.int64)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        left = middle * size - lo * size
        took = _node_draws(seed, name, lo, hi).binomial(here, left / (min(hi * size, k) - lo * size))
        here, lo, hi = (took, lo, middle) if number < middle else (here - took, middle, hi)
    return here


def tree_bootstrap(stats: DataFrame, samples: int = 2000, seed: int = 0, digits: int = 9, size: int = 256) -> DataFrame:
    """The interval of ``cluster_bootstrap``, exact draws of ``k`` personas with replacement, without a row for each draw.

    How often each persona is drawn in a sample is multinomial. Personas are numbered in hash order and gathered in blocks of ``size``; a block finds its own
    share of each sample's draws (``block_counts``) and splits it among its members. Each task adds up its blocks, so
    it sends ``samples`` sums for each comparison, whatever the number of personas.
    """
    keyed = stats.withColumn("__h", F.md5("persona_id"))
    numbered = number_rows(keyed, ["comparison"], ["__h", "persona_id"], F.conv(F.substring("__h", 1, 3), 16, 10).cast("bigint"), "idx")
    sizes = stats.groupBy("comparison").agg(F.count(F.lit(1)).alias("k"))
    blocks = numbered.withColumn("block", F.floor((F.col("idx") - 1) / size).cast("bigint")).groupBy("comparison", "block").agg(
        F.array_sort(F.collect_list(F.struct("idx", F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n")))).alias("m")).join(sizes, "comparison")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, number, members, k in zip(*[b.column(c).to_pylist() for c in ("comparison", "block", "m", "k")]):
                counts = block_counts(name, k, number, size, samples, seed)
                share = _node_draws(seed, name, "members", number).multinomial(counts, np.full(len(members), 1 / len(members)))
                values = np.array([(x["s"], x["n"]) for x in members])
                sums[name] = sums.get(name, 0) + share @ values
        for name, x in sums.items():
            yield pa.record_batch({"comparison": pa.array([name] * samples), "b": pa.array(range(samples), pa.int32()), "s": pa.array(x[:, 0]), "n": pa.array(x[:, 1])})

    parts = blocks.select("comparison", "block", "m", "k").mapInArrow(run, "comparison string, b int, s double, n double")
    means = parts.groupBy("comparison", "b").agg((F.sum("s") / F.sum("n")).alias("m"))
    return _interval(means, digits)


def persona_weighted(stats: DataFrame) -> DataFrame:
    """Statistics in which every persona counts once with its mean."""
    return stats.select("comparison", "persona_id", (F.col("s") / F.col("n")).alias("s"), F.lit(1).alias("n"))


FUNNEL = ("source_available", "indexed", "selected", "delivered", "learned_basis_selected", "learned_basis_delivered")


def funnel_summary(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, transition rates and accuracy with and without each stage, in one pass."""
    hits = {s: F.count_if(s) for s in FUNNEL}
    ok = F.col("answer_correct")
    rate = lambda a, b: F.try_divide(F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(b)))
    aggs = [F.count(F.lit(1)).alias("questions"), F.count_if(ok).alias("answer_correct"),
            *[c.alias(f"n_{s}") for s, c in hits.items()],
            rate("indexed", "source_available").alias("indexed_given_source"),
            rate("selected", "indexed").alias("selected_given_indexed"),
            rate("delivered", "selected").alias("delivered_given_selected"),
            (F.count_if(ok) / F.count(F.lit(1))).alias("accuracy")]
    for s in FUNNEL:
        aggs.append(F.try_divide(F.count_if(ok & F.col(s)), F.count_if(s)).alias(f"accuracy_given_{s}"))
        aggs.append(F.try_divide(F.count_if(ok & ~F.col(s)), F.count_if(~F.col(s))).alias(f"accuracy_without_{s}"))
    return records.groupBy(*by).agg(*aggs)


def funnel_violations(records: DataFrame) -> DataFrame:
    """Records whose stages contradict each other."""
    c = F.col
    reason = F.when(c("delivered") & ~c("selected"), "delivered_not_selected").when(
        c("selected") & ~c("indexed"), "selected_not_indexed").when(
        c("learned_basis_delivered") & ~c("learned_basis_selected"), "basis_delivered_not_selected").when(
        ~c("source_available") & (c("indexed") | c("selected") | c("delivered") | c("learned_basis_selected")),
        "unavailable_advanced")
    return records.withColumn("reason", reason).filter("reason IS NOT NULL").select("persona_id", "question_ref", "reason")


def ablation_summary(trials: DataFrame) -> DataFrame:
    """Per arm: counts of trial states and the cases whose trials agree in state and in text."""
    cases = trials.groupBy("arm", "case_ref").agg(
        F.count_if(F.col("state") == "formed").alias("formed"),
        F.count_if(F.col("state") == "no_change").alias("no_change"),
        F.count_if(F.col("state") == "malformed").alias("malformed"),
        (F.min("state") == F.max("state")).alias("same_state"),
        ((F.count("text") == 0) | ((F.count("text") == F.count(F.lit(1))) & (F.min("text") == F.max("text")))).alias("same_text"))
    return cases.groupBy("arm").agg(
        F.count(F.lit(1)).alias("cases"), F.sum("formed").alias("formed"), F.sum("no_change").alias("no_change"),
        F.sum("malformed").alias("malformed"), F.count_if("same_state").alias("stable_state"),
        F.count_if("same_text").alias("stable_text"))


def pairwise_tally(pairs: DataFrame) -> DataFrame:
    """Clear wins of either side, ties and inconsistent answers per comparison."""
    c = pairs.withColumn("winner", pair_consensus("forward_token", "reverse_token"))
    return c.groupBy("comparison").agg(*[
        F.count_if(F.col("winner") == w).alias(w + "_wins" if w in ("left", "right") else w)
        for w in ("left", "right", "tie", "inconsistent")])


def quantiles(log: DataFrame, by: Sequence[str], value: str, block, points: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Exact discrete quantiles per group.

    Equal values are counted before the shuffle, then a running count over value blocks finds the element, so no
    group is sorted in one task.
    """
    by = list(by)
    counts = log.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    total = log.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    run = running_sum(counts, by, [value], block, "__c", "__upto").join(total, by)
    return run.groupBy(*by).agg(*[
        F.min(F.when(F.col("__upto") >= F.greatest(F.ceil(F.col("__n") * p), F.lit(1)), F.col(value))).alias(f"p{round(p * 100)}")
        for p in points])


def latency_tokens(log: DataFrame, block) -> DataFrame:
    """p50 and p95 duration, sum and mean of tokens per operation."""
    q = quantiles(log, ["operation"], "duration", block)
    return log.groupBy("operation").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / F.count(F.lit(1))).alias("mean_tokens")).join(q, "operation")


def harness_matrix(results: DataFrame) -> DataFrame:
    """Exact-match rate of trimmed outputs per harness and mode; errors are kept apart."""
    ok = (F.col("error") == "") & (trimmed("output") == trimmed("expected"))
    answered = F.col("error") == ""
    return results.groupBy("harness", "mode").agg(
        F.count_if(answered).alias("answered"), F.count_if(~answered).alias("errors"), F.count_if(ok).alias("exact"),
        F.try_divide(F.count_if(ok), F.count_if(answered)).alias("exact_rate"))


# Cases a lifecycle run must contain.
LIFECYCLE = ("positive_complete", "no_delivery", "no_outcome", "negative_complete")


def lifecycle_summary(cases: DataFrame) -> DataFrame:
    """One row: passed and reasons, from one row of flags per lifecycle case.

    Flags: formed, rendered, expressed, reenacted, changed (revised or inhibited), future_changed.
    """
    flags = ("formed", "rendered", "expressed", "reenacted", "changed", "future_changed")
    value = lambda kind, flag: F.max(F.when(F.col("kind") == kind, F.col(flag))).alias(f"{kind}/{flag}")
    wide = cases.groupBy().agg(
        F.count_distinct("kind").alias("kinds"), F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("kind").isin(*LIFECYCLE)).alias("unknown"), *[value(k, f) for k in LIFECYCLE for f in flags])
    v = lambda kind, flag: F.col(f"`{kind}/{flag}`")
    positive, silent, plain, negative = LIFECYCLE
    checks = [F.when((F.col("kinds") != 4) | (F.col("unknown") > 0) | (F.col("rows") != F.col("kinds")), "all four lifecycle cases are required")]
    for kind in LIFECYCLE:
        checks += [F.when(~v(kind, f), f"{kind} did not prove {f}") for f in ("formed", "rendered", "expressed")]
    checks += [
        F.when(~v(positive, "reenacted"), "positive complete chain did not reenact"),
        F.when(v(silent, "reenacted") | v(silent, "changed"), "undelivered control changed the disposition"),
        F.when(v(plain, "changed"), "control without outcome changed the disposition"),
        F.when(~(v(negative, "changed") & v(negative, "future_changed")), "negative complete chain did not change selection"),
    ]
    reasons = F.array_compact(F.array(*checks))
    return wide.select((F.size(reasons) == 0).alias("passed"), F.array_join(reasons, "; ").alias("reasons"))


def owner_counters(episodes: DataFrame, jobs: DataFrame, consolidated: DataFrame, ops: DataFrame) -> DataFrame:
    """Per owner: episodes, jobs, pending jobs, consolidated episodes, pending index operations, readiness.

    ``consolidated`` has one row per window and episode; ``jobs``/``ops`` carry ``done``.
    """
    e = episodes.groupBy("owner").agg(F.count_distinct("episode_ref").alias("episodes"))
    j = jobs.groupBy("owner").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(~F.col("done")).alias("pending_jobs"))
    c = consolidated.select("owner", "episode_ref").distinct().groupBy("owner").agg(F.count(F.lit(1)).alias("consolidated"))
    o = ops.groupBy("owner").agg(F.count_if(~F.col("done")).alias("pending_ops"))
    full = e.join(j, "owner", "left").join(c, "owner", "left").join(o, "owner", "left").na.fill(0)
    return full.withColumn("ready", (F.col("pending_jobs") == 0) & (F.col("pending_ops") == 0)
                           & (F.col("consolidated") == F.col("episodes")))
