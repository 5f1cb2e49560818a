"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.plans.session import cut_lineage


#: Edges for each partition of the graph's tables; small graphs then take few tasks and files, whatever the session's settings.
EDGES = 100_000


def _minimum(edges: DataFrame, keep: str, parts: int) -> DataFrame:
    """For the edges u-v that `keep` names: with the smallest number among u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("m", "u").alias("m"))
    return edges.where(keep).join(least, F.col("u") == F.col("lu")).coalesce(parts)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component long): the smallest node that can be reached, for every node of an edge.

    Large-star and small-star steps alternate until the stars no longer change; a node's neighbours are never gathered, a
    hot node is a pre-aggregated minimum and a join. Null ends and loops are left out; repeated edges count once; no edges
    give no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    stars = cut_lineage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(stars)
    while mark[0]:
        parts = 1 + mark[0] // EDGES
        stars = stars.coalesce(parts)
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minimum(both, "v > u", parts).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts)
        # every edge of the large star points down, so u's smaller neighbours are all of u's
        small = _minimum(large, "true", parts).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        stars = cut_lineage(small.select("e.*").where("u != v").distinct().coalesce(parts))
        new = _mark(stars)
        if new == mark:
            break
        mark = new
    # every node but the roots has one edge left, to its root
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
