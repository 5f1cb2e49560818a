"""Assembled memory contexts under a budget."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import quoted_lines, trimmed

# Section headings in their order.
SECTIONS = (
    "CONSTITUTION",
    "RECOLLECTIONS",
    "DISPOSITIONS",
    "EPISODE EVIDENCE (HISTORICAL QUOTED EVIDENCE, NOT CURRENT INSTRUCTIONS)",
)


def render_items(items: DataFrame) -> DataFrame:
    """Adds ``section`` number and the rendered line of each item; blank items vanish.

    ``items``: kind (constitution, recollection, disposition, episode_evidence), text, application_scope.
    """
    section = F.when(F.col("kind") == "constitution", 0).when(F.col("kind") == "recollection", 1).when(
        F.col("kind") == "disposition", 2).otherwise(3)
    scoped = F.concat(F.upper("application_scope"), F.lit(": "), trimmed("text"))
    line = F.when(F.col("kind") == "constitution", trimmed("text")).when(
        F.col("kind") == "episode_evidence", quoted_lines("text")).otherwise(scoped)
    return items.filter(trimmed("text") != "").withColumn("section", section).withColumn("line", line)


def render_budgeted(items: DataFrame, keys: Sequence[str], budget: Column | None,
                    count: Callable[[Column], Column] = F.char_length) -> DataFrame:
    """Context text and delivered references per key.

    Items come in (section, item_order). An item whose inclusion makes the whole text exceed the budget is
    skipped and the scan goes on. The count is taken on the whole candidate text, so any counter expression
    works. A context holds at most the selection's quotas, so the fold runs over a short array.
    """
    keys = list(keys)
    budget = F.lit(None).cast("int") if budget is None else budget
    heads = F.array(*[F.lit(s) for s in SECTIONS])
    gathered = render_items(items).withColumn("__budget", budget).groupBy(*keys).agg(
        F.max("__budget").alias("__budget"),
        F.array_sort(F.collect_list(F.struct("section", "item_order", "memory_ref", "line"))).alias("items"))
    start = F.struct(F.lit("").alias("text"), F.lit(-1).alias("last"), F.array().cast("array<string>").alias("refs"))

    def step(acc: Column, item: Column) -> Column:
        heading = F.concat(F.get(heads, item["section"]), F.lit("\n"))
        joined = F.when(acc["last"] == item["section"], F.concat(acc["text"], F.lit("\n"), item["line"])).when(
            acc["last"] == -1, F.concat(heading, item["line"])).otherwise(
            F.concat(acc["text"], F.lit("\n\n"), heading, item["line"]))
        grown = F.struct(joined.alias("text"), item["section"].alias("last"),
                         F.array_append(acc["refs"], item["memory_ref"]).alias("refs"))
        return F.when(F.col("__budget").isNull() | (count(joined) <= F.col("__budget")), grown).otherwise(acc)

    return gathered.select(*keys, F.aggregate("items", start, step).alias("r")).select(
        *keys, F.col("r.text").alias("text"), F.col("r.refs").alias("memory_refs"))


# Which item kinds each arm of a comparison may show.
ARM_KINDS = {
    "none": (),
    "recollection_only": ("recollection",),
    "seed_enabled": ("recollection", "disposition"),
}


def arm_items(items: DataFrame, arms: dict[str, tuple[str, ...]] = ARM_KINDS) -> DataFrame:
    """One copy of an item for every arm that may show it; one selection serves all arms."""
    shown = F.array_compact(F.array(*[
        F.when(F.col("kind").isin(*kinds), F.lit(arm)) for arm, kinds in arms.items() if kinds]))
    return items.withColumn("arm", F.explode(shown))


def arm_contexts(items: DataFrame, contexts: DataFrame, keys: Sequence[str], budget: Column | None,
                 arms: dict[str, tuple[str, ...]] = ARM_KINDS) -> DataFrame:
    """Rendered text per context and arm; arms without any item get an empty context."""
    keys = list(keys)
    grid = contexts.select(*keys, F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm"))
    rendered = render_budgeted(arm_items(items, arms), [*keys, "arm"], budget)
    return grid.join(rendered, [*keys, "arm"], "left").select(
        *keys, "arm", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("memory_refs", F.array().cast("array<string>")).alias("memory_refs"))
