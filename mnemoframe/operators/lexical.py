"""Lexical relevance: topic terms for Latin text, character bigrams for everything else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import alnum_grams, bigram_bag, is_latin, let, squeezed, topic_terms, trimmed
from ..plans.session import cut_lineage
from ..plans.split import top_n


def features(text: str | Column) -> Column:
    """What scoring needs of one text, computed once per text.

    The bigram bag is kept for non-Latin text, which always needs it; Latin text gets its bag only inside a
    pair with non-Latin text.
    """
    t = F.col(text) if isinstance(text, str) else text
    latin = is_latin(t)
    terms = topic_terms(t)
    return F.struct(t.alias("text"), latin.alias("latin"),
                    F.when(latin, terms).alias("terms"),
                    F.when(latin, _codes(terms)).alias("codes"),
                    F.when(~latin, bigram_bag(t)).alias("bag"))


def _codes(terms: Column) -> Column:
    """A code for each term; NULL where two terms have the same."""
    return let(F.transform(terms, lambda w: F.hash(w)), lambda c: F.when(F.size(F.array_distinct(c)) == F.size(c), c))


def packed(features: Column, keep_text: Column) -> Column:
    """``features`` in the few bytes that ``unpacked`` needs: terms as one text, and the text itself where it is not Latin or to be kept."""
    f = features
    return F.struct(F.when(keep_text | ~f["latin"], f["text"]).alias("text"), f["latin"].alias("latin"), F.array_join(f["terms"], " ").alias("terms"))


def unpacked(p: Column) -> Column:
    """The ``features`` that were ``packed``; a Latin text may be missing."""
    terms = F.when(p["terms"] == "", F.array().cast("array<string>")).otherwise(F.split(p["terms"], " "))
    return F.struct(p["text"].alias("text"), p["latin"].alias("latin"), F.when(p["latin"], terms).alias("terms"),
                    F.when(p["latin"], _codes(terms)).alias("codes"), F.when(~p["latin"], bigram_bag(p["text"])).alias("bag"))


def may_reach(left: Column, right: Column, minimum: float) -> Column:
    """False only if the score is certainly below ``minimum``.

    Equal terms have equal 32-bit codes, and codes are kept only where a text's terms have different ones, so
    the number of shared codes bounds the shared terms from above. Comparing numbers is several times cheaper
    than comparing strings and spares most pairs the exact score.
    """
    sizes = F.size(left["codes"]) + F.size(right["codes"])
    known = left["codes"].isNotNull() & right["codes"].isNotNull()
    return F.when(known, 2.0 * F.size(F.array_intersect(left["codes"], right["codes"])) >= minimum * sizes).otherwise(True)


def known_terms(features: str) -> Column:
    """How many codes ``features`` hold; NULL where they hold none for sure."""
    return F.when(F.col(f"{features}.codes").isNotNull(), F.size(f"{features}.codes"))


def may_fit(left: Column, right: Column, minimum: float) -> Column:
    """``may_reach`` from ``known_terms`` alone: two texts share no more terms than the one with fewer has."""
    return F.coalesce(2.0 * F.when(left < right, left).otherwise(right) >= minimum * (left + right), F.lit(True))


def _dice(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def score(left: Column, right: Column) -> Column:
    """Dice over topic terms if both texts are Latin, else multiset Dice over bigrams of both."""
    bag = lambda f: F.coalesce(f["bag"], bigram_bag(f["text"]))
    return F.when(left["latin"] & right["latin"], _dice(left["terms"], right["terms"])).otherwise(
        let(bag(left), lambda a: let(bag(right), lambda b: _dice(a, b))))


def positive_scores(queries: DataFrame, texts: DataFrame, keys: Sequence[str], query: str, item: str) -> DataFrame:
    """(keys, query, item, score) for every pair of a key with a score above zero.

    Two inverted-index joins, one per lane, so only pairs that share a term or bigram exist, rows of one key
    spread over its terms, and counts are combined before the shuffle by pair. Inputs hold ``features``.
    """
    keys = list(keys)
    # analysed once, read by both lanes; codes are never read here
    read = F.struct(*[F.col(f"features.{c}") for c in ("text", "latin", "terms", "bag")]).alias("features")
    q, t = cut_lineage(queries.select(*keys, query, read)), cut_lineage(texts.select(*keys, item, read))

    def terms(df: DataFrame, name: str, size: str) -> DataFrame:
        return df.filter("features.latin").select(
            *keys, name, F.size("features.terms").alias(size), F.explode("features.terms").alias("term"))

    shared = terms(q, query, "nq").join(terms(t, item, "nt"), [*keys, "term"]).groupBy(*keys, query, item).agg(
        F.count(F.lit(1)).alias("common"), F.max("nq").alias("nq"), F.max("nt").alias("nt"))
    both = shared.unionByName(_gram_pairs(q, t, keys, query, item))
    return both.select(*keys, query, item, (2.0 * F.col("common") / (F.col("nq") + F.col("nt"))).alias("score"))


def _gram_pairs(q: DataFrame, t: DataFrame, keys: list[str], query: str, item: str) -> DataFrame:
    """Common bigrams of pairs that are not both Latin."""
    def grams(df: DataFrame, name: str, size: str, latin: str) -> DataFrame:
        bag = F.coalesce("features.bag", bigram_bag("features.text"))
        # outer: a plain explode tests the bag for rows first, and Spark moves that test below the joins, where every text gets its bag
        return df.withColumn("__bag", bag).select(
            *keys, name, F.col("features.latin").alias(latin), F.size("__bag").alias(size), F.explode_outer("__bag").alias("gram"))

    # a Latin text meets bigrams only where its key holds non-Latin text
    foreign = lambda df: df.filter("NOT features.latin").select(*keys).distinct()
    near = lambda df, other: df.filter("NOT features.latin").unionByName(
        df.filter("features.latin").join(foreign(other), keys, "left_semi"))
    return (
        grams(near(q, t), query, "nq", "ql").join(grams(near(t, q), item, "nt", "tl"), [*keys, "gram"])
        .filter("NOT (ql AND tl)").groupBy(*keys, query, item).agg(
            F.count(F.lit(1)).alias("common"), F.max("nq").alias("nq"), F.max("nt").alias("nt")))


#: A query's rarest terms are probed first, until their postings hold so many times k items.
FIRST = 4
_EPS = 1e-9


def best_overlaps(queries: DataFrame, items: DataFrame, keys: Sequence[str], query: str, item: str, k: int,
                  jaccard: bool = False, place: str | None = None) -> DataFrame:
    """(keys, query, item, score, place): all pairs above zero that can be among the ``k`` best of a query, with exact scores.

    ``queries`` and ``items`` hold ``terms``, arrays of different terms; scores are Dice or Jaccard. With ``place``, a column of both, only items before
    the query's place count. A query's terms are put in order of how many items have them. Its rarest terms give the first
    candidates and a k-th best score. A better pair must share so many terms that, by pigeonhole, one of them is among the query's
    first ones up to a place that follows from that score; only those are probed, and only items of fitting sizes. A term
    that stands in every text comes last and is probed only if nothing rarer gives k items.
    """
    keys, own = list(keys), [*keys, query]
    at = [place] if place else []
    # rows go by numbers, and a term of a key by 64 bits: equal codes of different terms only add pairs, which the exact score drops
    q = cut_lineage(queries.dropna(subset=own).select(*own, "terms", F.size("terms").alias("nq"), *[F.col(c).alias("__now") for c in at],
                                                      F.monotonically_increasing_id().alias("__asks")))
    t = cut_lineage(items.dropna(subset=[*keys, item]).select(*keys, item, "terms", F.size("terms").alias("nt"), *[F.col(c).alias("__at") for c in at],
                                                              F.monotonically_increasing_id().alias("__has")))
    code = F.explode(F.transform("terms", lambda w: F.xxhash64(*keys, w))).alias("code")
    postings = t.select("__has", "nt", *["__at" for _ in at], code)
    asked = q.select("__asks", "nq", *["__now" for _ in at], code)
    common = asked.select("code").distinct().join(postings.groupBy("code").agg(F.count(F.lit(1)).alias("df")), "code")
    # at most one row for each term of a query
    own_terms = W.partitionBy("__asks").orderBy("df", "code")
    before = F.sum("df").over(own_terms.rowsBetween(W.unboundedPreceding, -1))
    ranked = asked.join(common, "code").withColumn("pos", F.row_number().over(own_terms)).withColumn(
        "first", F.coalesce(before, F.lit(0)) < FIRST * k).withColumn("m", F.count(F.lit(1)).over(W.partitionBy("__asks")))
    ranked = cut_lineage(ranked)
    pair = ["__asks", "__has"]

    def met(terms: DataFrame) -> DataFrame:
        rows = terms.join(postings, "code")
        return rows.filter("__at < __now") if place else rows

    def scored(pairs: DataFrame) -> DataFrame:
        left = q.select("__asks", F.struct(*keys).alias("__key"), query, "nq", F.col("terms").alias("__q"))
        both = pairs.join(left, "__asks").join(t.withColumnRenamed("terms", "__t"), "__has").filter(F.col("__key") == F.struct(*keys))
        both = both.withColumn("__c", F.size(F.array_intersect("__q", "__t"))).filter("__c > 0")
        c = F.col("__c")
        score = c / (F.col("nq") + F.col("nt") - c) if jaccard else 2.0 * c / (F.col("nq") + F.col("nt"))
        return both.select(*pair, *own, item, score.alias("score"), *[F.col("__at").alias(c) for c in at])

    one = cut_lineage(scored(met(ranked.filter("first")).select(pair).distinct()))
    bound = top_n(one.select("__asks", "score"), ["__asks"], [F.col("score").desc()], k, "__r").filter(F.col("__r") == k).select("__asks", F.col("score").alias("least"))
    least = F.coalesce("least", F.lit(0.0))
    need = F.greatest(F.ceil((least * F.col("nq") if jaccard else least * F.col("nq") / (2 - least)) - _EPS), F.lit(1))
    fit = F.least("nq", "nt") / F.greatest("nq", "nt") if jaccard else 2.0 * F.least("nq", "nt") / (F.col("nq") + F.col("nt"))
    more = ranked.filter("NOT first").join(bound, "__asks", "left").withColumn("least", least).filter(F.col("pos") <= F.col("m") - need + 1)
    two = met(more).filter(fit >= F.col("least") - _EPS).select(pair).distinct().join(one.select(pair), pair, "left_anti")
    return one.unionByName(scored(two)).drop(*pair)


def ngram_neighbours(queries: DataFrame, history: DataFrame, keys: Sequence[str], query: str, item: str,
                     k: int = 3, n: int = 3, place: str | None = None) -> DataFrame:
    """Top ``k`` history items per query by Jaccard over letter/digit n-gram sets; zero scores never appear.

    With ``place``, a column of both, only items before the query's place count and equal scores go by place.
    """
    keys = list(keys)
    at = [place] if place else []
    grams = lambda df, name: df.select(*keys, name, *at, alnum_grams("text", n).alias("terms"))
    scored = best_overlaps(grams(queries, query), grams(history, item), keys, query, item, k, jaccard=True, place=place)
    return top_n(scored.select(*keys, query, item, "score", *at), [*keys, query], [F.col("score").desc(), *at, item], k)


def render_neighbours(top: DataFrame, turns: DataFrame, keys: Sequence[str], query: str, item: str) -> DataFrame:
    """(query, text): the turns found for a query (at most k), in order; ``turns`` has user_text, agent_text, outcome_text (NULL: none)."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), trimmed(c))
    outcome = F.when(trimmed(F.coalesce("outcome_text", F.lit(""))) != "", F.concat(F.lit("\n"), part("OUTCOME", "outcome_text"))).otherwise("")
    block = F.concat(part("SITUATION", "user_text"), F.lit("\n"), part("AGENT_ACT", "agent_text"), outcome)
    found = top.select(*keys, query, item, "rank").join(turns.select(*keys, item, block.alias("block")), [*keys, item])
    listed = found.groupBy(*keys, query).agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return listed.select(*keys, query, F.concat(F.lit("EPISODES\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")).alias("text"))


def bounded_targets(windows: DataFrame, active: DataFrame, keys: Sequence[str], window: str,
                    indexed: DataFrame | None = None, n: int = 64, newest_first: bool = True) -> DataFrame:
    """Shortlist of active memories per window: best scores, then newest, then reference; plus indexed ones.

    ``windows`` hold ``features`` of the window's query text, ``active`` of the memory text. Memories without
    any overlap score zero and follow in (newest, reference) order, which is the same for all windows of an
    owner: its first ``n`` always hold enough of them. So no window is paired with the whole catalogue, nor with all that share a
    common term with it (``best_overlaps``). Texts of an owner that has no more than ``n`` are not scored: nothing is left out there.
    """
    keys = list(keys)
    tail = [F.col("created_order").desc(), "version_ref"] if newest_first else ["version_ref"]
    newest = top_n(active.select(*keys, "version_ref", "created_order"), keys, tail, n, "__fill")
    filler = windows.select(*keys, window).join(newest, keys).select(
        *keys, window, "version_ref", "created_order", F.lit(0.0).alias("score"))
    # who has at most n memories is offered all of them, whatever they score; codes are never read here
    crowded = active.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > n).select(*keys)
    read = F.struct(*[F.col(f"features.{c}") for c in ("text", "latin", "terms", "bag")]).alias("features")
    w, a = (cut_lineage(df.join(crowded, keys, "left_semi").select(*keys, name, read)) for df, name in ((windows, window), (active, "version_ref")))
    latin = lambda df, name: df.filter("features.latin").select(*keys, name, F.col("features.terms").alias("terms"))
    foreign = _gram_pairs(w, a, keys, window, "version_ref")
    scores = best_overlaps(latin(w, window), latin(a, "version_ref"), keys, window, "version_ref", n).unionByName(
        foreign.select(*keys, window, "version_ref", (2.0 * F.col("common") / (F.col("nq") + F.col("nt"))).alias("score")))
    hits = scores.join(active.select(*keys, "version_ref", "created_order"), [*keys, "version_ref"])
    pool = hits.select(filler.columns).unionByName(filler).groupBy(*keys, window, "version_ref", "created_order").agg(
        F.max("score").alias("score"))
    best = top_n(pool, [*keys, window], [F.col("score").desc(), *tail], n).select(*keys, window, "version_ref")
    if indexed is None:
        return best
    extra = indexed.join(active.select(*keys, "version_ref"), [*keys, "version_ref"], "left_semi").select(best.columns)
    return best.unionByName(extra).distinct()


def squeezed_dice(a: str | Column, b: str | Column) -> Column:
    """Bigram Dice of two texts, whatever their script."""
    return let(bigram_bag(a), lambda x: let(bigram_bag(b), lambda y: _dice(x, y)))


__all__ = ["bounded_targets", "features", "ngram_neighbours", "positive_scores", "score", "squeezed", "squeezed_dice"]
