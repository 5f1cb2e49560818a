"""URL filter: host and path rules, and the likelihood ratio of two character models for what no rule decides."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import spans
from mnemoframe.plans.session import cut_lineage

#: Longest context in bytes, and the logarithm of the number of hashed contexts of each length.
ORDER = 4
LOG_PLACES = 18
PLACES = 1 << LOG_PLACES
#: How many observations the shorter context counts for.
WEIGHT = 4.0
#: Score bins in which the threshold is sought.
BINS = 400
SPAN = 4.0

#: fixed values: the rules of the contract (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Words of hosts that mark a URL as rejected when the models learn: usual names of adult, betting, drug, loan, advert, pirate and malware sites.
REJECTED_WORDS = tuple("""
    adult camgirls cams erotic erotica escort escorts fetish hentai milf nsfw nude nudes porn porno pornos sex sexcam sexy webcams xxx
    baccarat bet bets betting bingo blackjack bookmaker casino casinos gamble gambling jackpot jackpots lotto poker roulette slot slots sportsbook wager
    cialis meds pharma pharmacy pill pills steroid steroids tramadol viagra xanax
    cashadvance debt forex loan loans payday
    ad ads adserver adserv advert adverts adware banners clickbait doubleclick popunder popup popups tracker tracking
    crack cracked cracks keygen nulled serials torrent torrents warez
    botnet fakeid hoax malware phish phishing ransomware replica replicas scam scams spam spammer spyware trojan virus
""".split())
#: Rejected hosts that must share a word before it marks other hosts.
SUPPORT = 2
#: Share of URLs that a threshold may misjudge where only one class is known.
ALONE = 0.005
#: Hosts that are broadcast; more are joined.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path; both empty for null and for URLs without ://."""
    part = [F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2)]
    return F.translate(part[0], _UPPER, _LOWER), part[1]


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path in one string) and its verdict; null if none fits. Equally long ones: the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, suffix, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(start)
        # an equally long rule that stands earlier wins: it is laid over later
        name, verdict = F.when(fits, suffix + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ORDER + 1, bytes) places of each byte behind its last 0 to ORDER bytes, the same for the contexts alone, and each text's begin.

    Bytes before a text are 0. ASCII letters are folded.
    """
    data, offsets = spans.buffers(texts)
    data = data.astype(np.uint64)
    data = np.where((data >= 65) & (data < 91), data + np.uint64(32), data)
    since = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    context = np.zeros(len(data), dtype=np.uint64)
    pairs, alone = [], []
    for k in range(ORDER + 1):
        if k:
            before = np.zeros(len(data), dtype=np.uint64)
            before[k:] = data[:-k]
            context = context | np.where(since >= k, before, 0).astype(np.uint64) << np.uint64(8 * k)
        pairs.append((spans.mix(context | data, 2 * k) >> np.uint64(64 - LOG_PLACES)).astype(np.int64))
        alone.append((spans.mix(context, 2 * k + 1) >> np.uint64(64 - LOG_PLACES)).astype(np.int64))
    return np.array(pairs).reshape(ORDER + 1, -1), np.array(alone).reshape(ORDER + 1, -1), offsets


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, place, n): counts of this task; kind has the class, the order, and whether the byte is part of the place."""
    total: dict[int, np.ndarray] = {}
    for b in spans.slices(batches, "url"):
        pairs, alone, offsets = _codes(b.column("url"))
        good = np.repeat(b.column("good").to_numpy(zero_copy_only=False), np.diff(offsets))
        for k in range(ORDER + 1):
            for which, codes in ((0, pairs[k]), (1, alone[k])):
                for c in (0, 1):
                    kind = (c * (ORDER + 1) + k) * 2 + which
                    total.setdefault(kind, np.zeros(PLACES, dtype=np.int64))
                    total[kind] += np.bincount(codes[good == bool(c)], minlength=PLACES)
    for kind, x in total.items():
        at = np.flatnonzero(x)
        yield pa.record_batch({"kind": pa.array(np.full(len(at), kind, dtype=np.int32)), "place": pa.array(at), "n": pa.array(x[at])})


class Ratio:
    """Counts of both classes, and the score of a URL: mean log of the chance if accepted less that if rejected, for a byte."""

    def __init__(self, counts: pa.Table):
        self.counts = np.zeros(((ORDER + 1) * 4, PLACES), dtype=np.float32)
        self.counts[counts.column("kind").to_numpy(), counts.column("place").to_numpy()] = counts.column("n").to_numpy()

    def scores(self, urls: pa.Array) -> np.ndarray:
        pairs, alone, offsets = _codes(urls)
        logs = []
        for c in (1, 0):
            chance = np.full(pairs.shape[1], 1 / 256)
            for k in range(ORDER + 1):
                kind = (c * (ORDER + 1) + k) * 2
                chance = (self.counts[kind][pairs[k]] + WEIGHT * chance) / (np.maximum(self.counts[kind + 1][alone[k]], self.counts[kind][pairs[k]]) + WEIGHT)
            logs.append(np.concatenate([[0], np.cumsum(np.log(chance))]))
        total = [x[offsets[1:]] - x[offsets[:-1]] for x in logs]
        return np.round((total[0] - total[1]) / np.maximum(np.diff(offsets), 1), 9)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, "url"):
            out = {n: b.column(n) for n in b.schema.names}
            yield pa.record_batch(out | {"score": pa.array(model.value.scores(pc.fill_null(b.column("url"), "")))})
    return run


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def rejected_hosts(rows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(host): hosts that share words with rejected ones. rows: host, bad (rejected by its words), fine (a rule allows a URL of it).

    A word (not of the last label, as com) that stands in `support` rejected hosts and in no accepted one marks the hosts that have it and are neither, which are
    rejected from then on; this goes on until no host is added.
    """
    hosts = cut_lineage(rows.where("host != ''").groupBy("host").agg(F.max("bad").alias("bad"), F.max("fine").alias("fine")))
    words = cut_lineage(hosts.select("host", "bad", (F.col("fine") & ~F.col("bad")).alias("fine"), F.explode(F.array_distinct(F.split(F.regexp_replace("host", r"\.[^.]*$", ""), "[.-]"))).alias("word")).where("word != ''"))
    # only words of undecided hosts that no accepted host has
    open_words = cut_lineage(words.groupBy("word").agg(F.max("fine").alias("fine"), F.max(~F.col("bad")).alias("undecided")).where("not fine and undecided").select("word"))
    words = cut_lineage(words.where("not fine").join(_few(open_words), "word", "left_semi").select("host", "word", "bad"))
    found = None
    while True:
        if found is None:
            known = words
        else:
            known = words.join(_few(found).withColumn("more", F.lit(True)), "host", "left").select("host", "word", (F.col("bad") | F.col("more").isNotNull()).alias("bad"))
        marks = cut_lineage(known.groupBy("word").agg(F.sum(F.col("bad").cast("int")).alias("n")).where(F.col("n") >= support).select("word"))
        now = cut_lineage(words.where("not bad").join(_few(marks), "word", "left_semi").select("host").distinct())
        if now.count() == (0 if found is None else found.count()):
            return now
        found = now


def threshold(bins: list[tuple[int, bool, int]]) -> float:
    """The lower edge of the score bin from which on URLs are allowed: least sum of both classes' error shares, the lowest of equals.

    With one class only, the edge that ALONE of its URLs miss; without any, the lowest one.
    """
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for k, accepted, n in bins:
        (good if accepted else bad)[k] += n
    if not bad.sum():
        k = int((np.cumsum(good) > ALONE * good.sum()).argmax()) if good.sum() else 0
        return k * 2 * SPAN / BINS - SPAN if k else -np.inf
    if not good.sum():
        return float((BINS - int((np.cumsum(bad[::-1]) > ALONE * bad.sum()).argmax()) + 1) * 2 * SPAN / BINS - SPAN)
    lost = np.concatenate([[0], np.cumsum(good)[:-1]]) / good.sum()
    passed = (bad.sum() - np.concatenate([[0], np.cumsum(bad)[:-1]])) / bad.sum()
    return float(int((lost + passed).argmin()) * 2 * SPAN / BINS - SPAN)


def _aside(lessons: DataFrame) -> Column:
    """Which lessons calibrate: those of whole hosts, so that no host is both learned and tested."""
    by_host = F.pmod(F.crc32("host"), F.lit(5)) == 0
    sides = lessons.groupBy("good", by_host.alias("aside")).agg(F.count("*").alias("n")).collect()
    whole = {(x["good"], x["aside"]) for x in sides}
    if all((good, aside) in whole for good, _ in whole for aside in (True, False)):
        return by_host
    return F.pmod(F.crc32("url"), F.lit(5)) == 0


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, rejected_words: Sequence[str] = REJECTED_WORDS) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, score.

    A rule (allow or block, host, path) fits its host and all subdomains if the URL's path starts with the rule's; the longest
    that fits decides. All other URLs are judged by two byte models with contexts of 0 to 4 bytes, each smoothed by the shorter
    one. Rejected are, when they learn, all URLs with one of rejected_words as a word of the host, and those of hosts that rejected
    ones lead to by further words (see rejected_hosts); accepted all others that a rule allows. (A blocking rule closes a place on a site and says nothing on the kind of its URLs; models that learned from those
    blocked three in five URLs of hosts that no rule names.) The lessons of one host in five (by CRC-32; one URL in five, if a class
    then has hosts on one side only) are left out and calibrate the threshold on the mean log ratio for a byte, by the least sum of
    both error shares. With lessons of one class only, the other model knows nothing (all bytes are as likely), and the threshold
    leaves 99.5 % of that class on its side. Models are counts in 2^18 hashed places for
    each context length, whatever the size of the table.

    Null URLs and those without :// have empty host and path, fit no rule and are blocked; an empty path fits only rules without a
    path. Without any lesson all scores are equal, and what no rule decides is allowed. Null page_ids and repeated rows are rows
    like others; columns other than the two named ones are not looked at; an empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("ruled", verdict)
    bad_word = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, rejected_words))) if rejected_words else F.lit(False)
    fine = F.coalesce(F.col("ruled") == "allow", F.lit(False))
    also = rejected_hosts(rows.select("host", bad_word.alias("bad"), fine.alias("fine")))
    # one row a host
    marked = rows.join(_few(also).withColumn("led", F.lit(True)), "host", "left")
    bad_word = bad_word | F.col("led").isNotNull()
    lessons = marked.where(bad_word | (F.col("ruled") == "allow")).select("host", "url", (~bad_word).alias("good"))
    lessons = lessons.withColumn("aside", _aside(lessons))
    counts = lessons.where("not aside").select("url", "good").mapInArrow(_counted, "kind int, place long, n long").groupBy("kind", "place").agg(F.sum("n").alias("n"))
    # at most 20 x 2^18 rows
    model = Ratio(counts.toArrow())
    shared = spark.sparkContext.broadcast(model)
    edge = F.least(F.greatest(F.floor((F.col("score") + SPAN) / (2 * SPAN / BINS)), F.lit(0)), F.lit(BINS)).cast("int")
    tested = lessons.where("aside").select("url", "good").mapInArrow(_scored(shared), "url string, good boolean, score double")
    least = threshold([(x["k"], x["good"], x["n"]) for x in tested.groupBy(edge.alias("k"), "good").agg(F.count("*").alias("n")).collect()])
    scored = rows.mapInArrow(_scored(shared), "id long, url string, host string, path string, rule string, ruled string, score double")
    learned = F.when(F.coalesce(F.instr("url", "://"), F.lit(0)) == 0, "block").when(F.col("score") >= least, "allow").otherwise("block")
    return scored.select(F.col("id").alias("page_id"), "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")


def op4_url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
