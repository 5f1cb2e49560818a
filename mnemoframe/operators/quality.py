"""Data quality: orphans, leaks, coverage, deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.refs import version_root


def orphan_checks(checks: Sequence[tuple[str, DataFrame, DataFrame, Sequence[str], str]]) -> DataFrame:
    """Rows without their parent. Each check: name, child, parent, key columns, column that identifies the child."""
    parts = [
        child.select(*key, F.col(ident).alias("item") if ident not in key else F.col(ident)).join(
            parent.select(*key).distinct(), list(key), "left_anti").select(
            F.lit(name).alias("check"), F.col("item" if ident not in key else ident).cast("string").alias("item"))
        for name, child, parent, key, ident in checks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leak_check(inputs: DataFrame, secrets: DataFrame, key: str) -> DataFrame:
    """Scorer-only texts that occur in a model input of the same instance."""
    return inputs.join(secrets.filter("secret <> ''"), key).filter(F.contains("input", "secret")).select(
        key, "secret_kind").distinct()


def oracle_leaks(results: DataFrame, oracle_mode: str = "oracle_episode") -> DataFrame:
    """Answers whose oracle flag does not fit their arm."""
    return results.filter(F.col("oracle_label_used") != (F.col("mode") == oracle_mode)).select(
        "persona_id", "question_ref", "mode")


def coverage(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """Missing, unexpected and duplicate keys."""
    key = list(key)
    e = expected.select(*key).distinct().withColumn("__e", F.lit(True))
    a = actual.groupBy(*key).agg(F.count(F.lit(1)).alias("__a"))
    problem = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__a") > 1, "duplicate")
    return e.join(a, key, "full_outer").withColumn("problem", problem).filter("problem IS NOT NULL").select(*key, "problem")


def basis_delta(before: DataFrame, after: DataFrame, roles: Sequence[str], lineage: bool = False) -> DataFrame:
    """Basis rows that were added or removed; versions of one memory are one lineage if asked."""
    ref = version_root("version_ref") if lineage else F.col("version_ref")
    cut = lambda df: df.filter(F.col("role").isin(*roles)).select(ref.alias("ref"), "episode_ref", "role").distinct()
    key = ["ref", "episode_ref", "role"]
    b, a = cut(before).withColumn("__b", F.lit(True)), cut(after).withColumn("__a", F.lit(True))
    return b.join(a, key, "full_outer").filter("__b IS NULL OR __a IS NULL").select(
        *key, F.when(F.col("__b").isNull(), "added").otherwise("removed").alias("change"))


def snapshot_unchanged(before: DataFrame, after: DataFrame, owner: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per owner whether the two states hold the same rows."""
    row = F.sha2(F.concat_ws("\0", *[F.col(c).cast("string") for c in columns]), 256)
    count = lambda df, name: df.select(*owner, row.alias("__h")).groupBy(*owner, "__h").agg(F.count(F.lit(1)).alias(name))
    both = count(before, "__b").join(count(after, "__a"), [*owner, "__h"], "full_outer")
    return both.groupBy(*owner).agg(F.min(F.col("__b").eqNullSafe(F.col("__a"))).alias("unchanged"))


def single_history(questions: DataFrame) -> DataFrame:
    """Personas with more than one history."""
    return questions.groupBy("persona_id").agg(F.min("history").alias("a"), F.max("history").alias("b")).filter(
        "a <> b").select("persona_id")
