"""Search lanes and rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import trimmed
from ..plans.session import cut_lineage
from ..plans.split import top_n
from .intake import stable_tight

KINDS = ("EPISODE", "RECOLLECTION", "DISPOSITION")


def search_lanes(hits: DataFrame, request: Sequence[str], limit: int = 40) -> DataFrame:
    """Raw provider rankings to lanes.

    ``hits``: request, owner_index, query_index, n_queries, position (from 0), kind, ref. Every owner and query
    forms a lane, numbered owner first; a lane keeps its first ``limit`` raw entries, then drops unknown kinds
    and repetitions. The rank stays the raw position.
    """
    request = list(request)
    valid = hits.filter(F.col("position") < limit).filter(F.col("kind").isin(*KINDS) & (F.col("ref") != ""))
    lane = (F.col("owner_index") * F.col("n_queries") + F.col("query_index")).cast("bigint")
    rest = [c for c in hits.columns if c not in (*request, "position", "kind", "ref", "owner_index", "query_index", "n_queries")]
    return valid.withColumn("lane_order", lane).groupBy(*request, "lane_order", "kind", "ref", *rest).agg(
        F.min("position").alias("rank"))


def merge_lanes(hits: DataFrame, keys: Sequence[str], limit: int = 64) -> DataFrame:
    """First-seen union of the answers to the distinct query texts of a window, each kind bounded.

    ``hits``: keys, query_no, query_text, position (from 0), kind, ref.
    """
    keys = list(keys)
    said = hits.withColumn("query_text", trimmed("query_text")).filter("query_text <> ''")
    first = said.groupBy(*keys, "query_text").agg(F.min("query_no").alias("query_no"))
    once = said.filter((F.col("position") < limit) & F.col("kind").isin(*KINDS) & stable_tight("ref")).join(
        first, [*keys, "query_text", "query_no"], "left_semi")
    seen = once.groupBy(*keys, "kind", "ref").agg(F.min(F.struct("query_no", "position")).alias("seen"))
    return top_n(seen, [*keys, "kind"], ["seen"], limit).drop("seen")


def fuse_ranks(rankings: DataFrame, keys: Sequence[str], views: int = 2, limit: int = 64) -> DataFrame:
    """Episode references ordered by the sum of their ranks over the views, then worst rank, then first view.

    ``rankings``: keys, view (from 0), position (from 0), kind, ref. Ranks count valid distinct episodes within
    the first ``limit`` raw entries; a view without the episode counts ``limit + 1``.
    """
    keys = list(keys)
    valid = rankings.filter((F.col("position") < limit) & (F.col("kind") == "EPISODE") & stable_tight("ref"))
    once = valid.groupBy(*keys, "view", "ref").agg(F.min("position").alias("position"))
    ranked = once.withColumn("r", F.row_number().over(W.partitionBy(*keys, "view").orderBy("position")))
    per_view = [F.coalesce(F.max(F.when(F.col("view") == v, F.col("r"))), F.lit(limit + 1)).alias(f"r{v}") for v in range(views)]
    merged = ranked.groupBy(*keys, "ref").agg(*per_view, F.min(F.struct("view", "position")).alias("seen"))
    cols = [F.col(f"r{v}") for v in range(views)]
    total = sum(cols[1:], cols[0])
    worst = F.greatest(*cols) if views > 1 else cols[0]
    return top_n(merged.withColumn("rank_sum", total).withColumn("worst", worst), keys,
                 ["rank_sum", "worst", "r0", "seen", "ref"], limit).drop("seen")


def kind_topk(ranking: DataFrame, documents: DataFrame, keys: Sequence[str], kind: str, n: int) -> tuple[DataFrame, DataFrame]:
    """First ``n`` documents of one kind from a mixed ranking, and the reasons why a ranking is invalid.

    ``ranking``: keys, query_ref, position, kind, ref; ``documents``: keys, kind, ref. The ranking is read by each check and made once.
    """
    keys = list(keys)
    ranking = cut_lineage(ranking)
    ask = [*keys, "query_ref"]
    of_kind = ranking.filter(F.col("kind") == kind)
    docs = documents.filter(F.col("kind") == kind).select(*keys, "ref")
    known = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__known"))
    top = top_n(of_kind, ask, ["position"], n)
    duplicate = of_kind.groupBy(*ask, "ref").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(
        *ask, F.lit("duplicate").alias("reason"))
    unknown = of_kind.join(docs, [*keys, "ref"], "left_anti").select(*ask, F.lit("unknown").alias("reason"))
    short = ranking.groupBy(*ask).agg(F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias("__got")).join(
        known, keys).filter(F.col("__got") < F.least(F.lit(n), F.col("__known"))).select(*ask, F.lit("short").alias("reason"))
    return top, duplicate.unionByName(unknown).unionByName(short).distinct()


def keyset_page(documents: DataFrame, after_kind: int, after_ref: str, limit: int) -> DataFrame:
    """One page after a (kind_order, ref) cursor; ``has_more`` tells whether another follows."""
    later = documents.filter((F.col("kind_order") > after_kind) | (
        (F.col("kind_order") == after_kind) & (F.col("ref") > after_ref)))
    page = later.orderBy("kind_order", "ref").limit(limit + 1)
    numbered = page.withColumn("__n", F.row_number().over(W.orderBy("kind_order", "ref")))
    return numbered.withColumn("has_more", F.max("__n").over(W.partitionBy()) > limit).filter(
        F.col("__n") <= limit).drop("__n")
