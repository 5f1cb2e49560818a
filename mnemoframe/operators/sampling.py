"""Hash-ordered samples, splits and arm orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.split import top_n


def hash_key(salt: str | Column, *values: str) -> Column:
    """Hex SHA-256 of the salt and values joined by a colon."""
    first = F.lit(salt) if isinstance(salt, str) else salt
    return F.sha2(F.concat_ws(":", first, *[F.col(v) for v in values]), 256)


def hash_sample(questions: DataFrame, personas: int, per_persona: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """First personas by hash and their first questions by hash, and the personas with too few questions."""
    seeds = F.lit(str(seed))
    people = questions.groupBy("persona_id").agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", hash_key(seeds, "persona_id"))
    chosen = people.orderBy("__h").limit(personas)
    short = chosen.filter(F.col("__n") < per_persona).select("persona_id", F.col("__n").alias("questions"))
    pool = questions.join(chosen.select("persona_id"), "persona_id", "left_semi").withColumn("__q", hash_key(seeds, "question_ref"))
    return top_n(pool, ["persona_id"], ["__q"], per_persona).drop("__q"), short


def persona_split(personas: DataFrame, exposed: DataFrame, salt: str, dev: int, holdout_1: int) -> DataFrame:
    """dev, H1 and H2: exposed personas go to dev, the rest are cut by hash order.

    ``dev`` and ``holdout_1`` are sizes; the exposed count towards dev, and more of them leave H1 its size. Only the first
    of the others are ranked, which a distributed limit bounds by those sizes; everyone else is H2 by absence.
    """
    seen = exposed.select("persona_id").distinct().withColumn("__exposed", F.lit(True))
    marked = personas.select("persona_id").distinct().join(seen, "persona_id", "left").withColumn(
        "__h", hash_key(salt, "persona_id"))
    free = marked.agg(F.greatest(F.lit(dev) - F.count("__exposed"), F.lit(0)).alias("__free"))
    # one ordered list of at most dev + holdout_1 personas, and one row with the places that dev has left
    listed = marked.filter("__exposed IS NULL").orderBy("__h").limit(dev + holdout_1)
    placed = listed.withColumn("__i", F.row_number().over(W.orderBy("__h"))).crossJoin(F.broadcast(free))
    named = placed.select("persona_id", F.when(F.col("__i") <= F.col("__free"), "dev").when(F.col("__i") <= F.col("__free") + holdout_1, "H1").alias("split"))
    return marked.select("persona_id", "__exposed").join(named, "persona_id", "left").select(
        "persona_id", F.coalesce("split", F.when(F.col("__exposed"), "dev"), F.lit("H2")).alias("split"))


def arm_order(questions: DataFrame, key: Sequence[str], arms: Sequence[str], namespace: str) -> DataFrame:
    """Place of each arm per question by hash, so that no arm always goes first."""
    keyed = F.array(*[F.struct(
        F.sha2(F.concat_ws(":", F.lit(namespace), *key, F.lit(a)), 256).alias("h"), F.lit(a).alias("arm")) for a in arms])
    rows = questions.select(*key, F.posexplode(F.array_sort(keyed)).alias("place", "x"))
    return rows.select(*key, "place", "x.arm")
