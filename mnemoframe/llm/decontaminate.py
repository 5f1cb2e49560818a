"""Benchmark decontamination: rare pairs of words find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import spans
from mnemoframe.llm.tables import documents, fresh
from mnemoframe.plans.session import cut_lineage

#: So many seeds of an item must stand together before it is aligned; items of which a copy may keep fewer need fewer.
TOGETHER = 3
#: Places of seeds that are looked at once.
HITS = 1 << 22
#: Part of an item's best possible score that marks a passage as a copy.
RATIO = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Text of benchmark items that is compared at once.
BLOCK_BYTES = 8 << 20
#: Cells of alignment matrices that are computed at once.
CELLS = 1 << 20

_MARKS = ~spans.byte_set(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, and each text's first. A word is a run of ASCII letters and digits and of other code points."""
    data, offsets = spans.buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends, first = spans.word_spans(data, offsets, _MARKS)
    return spans.hashes(data, starts, ends), first


class Grams:
    """Which of the known words (kind 1) and pairs of words (kind 2: neighbours, or with one word between) stand where."""

    def __init__(self, known: dict[int, np.ndarray]):
        """known: sorted hashes by kind."""
        self.known = known
        self.maybe = {}
        for kind, values in known.items():
            self.maybe[kind] = np.zeros(1 << 22, dtype=bool)
            self.maybe[kind][(values & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def found(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind and gap: kind, the number of the word or pair in known, its text, its first word in the text."""
        for kind, values in self.known.items():
            for gap in (0,) if kind == 1 else (1, 2):
                grams = pair_hashes(words, gap) if gap else words
                at = np.flatnonzero(self.maybe[kind][(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
                which = np.searchsorted(values, grams[at])
                at, which = (x[values[np.minimum(which, len(values) - 1)] == grams[at]] for x in (at, which))
                text = np.searchsorted(first, at, side="right") - 1
                whole = at + gap < first[text + 1]
                yield kind, which[whole], text[whole], (at - first[text])[whole]


def pair_hashes(words: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of each word with the one `gap` places on."""
    return spans.mix(words[:-gap] * np.uint64(spans._BASE) + words[gap:])


class Items:
    """One block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], ratio: float = RATIO):
        words, first = word_hashes(pa.array(texts, pa.string()))
        self.ids = np.array(ids, dtype=np.int64)
        self.words = [words[i:j] for i, j in zip(first[:-1], first[1:])]
        lengths = np.diff(first)
        # a copy with m equal words has 2 m - least edits at most, so least / 2 - 1 of its equal words at least are followed by the next one after one edit or none
        least = ratio * MATCH * lengths
        #: Words that start such pairs, in every copy.
        self.starts = np.maximum(np.ceil(least / MATCH).astype(np.int64) - 1, 0)
        #: Edits in a copy at most.
        self.slack = np.maximum(np.floor(MATCH * lengths - least).astype(np.int64), 0)
        #: Seeds that must stand together.
        self.together = np.clip(self.starts, 1, TOGETHER)
        self.grams = []
        for w, k in zip(self.words, self.starts):
            if k or not len(w):
                near, far = (pair_hashes(w, g) if len(w) > g else w[:0] for g in (1, 2))
                self.grams.append((2, near, far))
            else:  # a single equal word makes a copy
                self.grams.append((1, w, w[:0]))

    def all(self) -> dict[int, np.ndarray]:
        out: dict[int, list] = {}
        for kind, near, far in self.grams:
            if len(near):
                out.setdefault(kind, []).extend((near, far))
        return {kind: np.unique(np.concatenate(x)) for kind, x in out.items()}

    def seeds(self, known: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, tuple]]:
        """The rarest words of an item that start pairs, so many that each copy keeps `together` of them: hashes by kind, and for each the items and places that have it."""
        rows: dict[int, list] = {}
        for item, (kind, near, far) in enumerate(self.grams):
            if not len(near):
                continue
            often = counts[kind][np.searchsorted(known[kind], near)]
            often[:len(far)] += counts[kind][np.searchsorted(known[kind], far)]
            some = np.lexsort((near, often))[:max(0, len(near) - max(int(self.starts[item]), 1) + int(self.together[item]))] if kind == 2 else np.arange(len(near))
            also = some[some < len(far)]
            places = np.concatenate([some, also])
            rows.setdefault(kind, []).append((np.concatenate([near[some], far[also]]), np.full(len(places), item), places))
        hashes, places = {}, {}
        for kind, found in rows.items():
            h, item, place = map(np.concatenate, zip(*found))
            order = np.lexsort((place, item, h))
            hashes[kind], start = np.unique(h[order], return_index=True)
            places[kind] = (np.append(start, len(h)), item[order], place[order])
        return hashes, places


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman scores of pairs of word sequences, and the number of the passage's word after the aligned part."""
    rows, width = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), rows), dtype=np.uint64), np.zeros((len(items), width), dtype=np.uint64)
    in_a, in_b = np.zeros(a.shape, dtype=bool), np.zeros(b.shape, dtype=bool)
    for k, (x, y) in enumerate(zip(items, passages)):
        a[k, :len(x)], in_a[k, :len(x)] = x, True
        b[k, :len(y)], in_b[k, :len(y)] = y, True
    slope = np.arange(width + 1, dtype=np.int32) * GAP
    above = np.zeros((len(items), width + 1), dtype=np.int32)
    best, end = np.zeros(len(items), dtype=np.int32), np.zeros(len(items), dtype=np.int64)
    for i in range(rows):
        here = in_a[:, i:i + 1] & in_b
        score = np.where(here & (a[:, i:i + 1] == b), MATCH, MISMATCH).astype(np.int32)
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(np.maximum(above[:, :-1] + score, above[:, 1:] + GAP), 0)
        # a gap along the row: the best cell before, less GAP a step
        row = np.maximum.accumulate(row - slope, axis=1) + slope
        row[~in_a[:, i]] = above[~in_a[:, i]]
        top = row.argmax(axis=1)
        value = row[np.arange(len(items)), top]
        end = np.where(value > best, top, end)
        best = np.maximum(best, value)
        above = row
    return best, end


def _counts(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often this task's texts hold each word or pair of the items."""
        grams = Grams(known.value)
        total = {n: np.zeros(len(v), dtype=np.int64) for n, v in known.value.items()}
        for b in spans.slices(batches, "t"):
            for n, which, _, _ in grams.found(*word_hashes(b.column("t"))):
                total[n] += np.bincount(which, minlength=len(total[n]))
        for n, x in total.items():
            at = np.flatnonzero(x)
            yield pa.record_batch({"n": pa.array(np.full(len(at), n, dtype=np.int32)), "gram": pa.array(at), "times": pa.array(x[at])})
    return run


def _matches(shared, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hashes, places = shared.value
        grams = Grams(hashes)
        for b in spans.slices(batches, "t"):
            words, first = word_hashes(b.column("t"))
            found = [(np.full(len(which), n), which, t, at, places[n][0][which + 1] - places[n][0][which]) for n, which, t, at in grams.found(words, first)]
            if not sum(len(x[1]) for x in found):
                continue
            kind, which, t, at, times = map(np.concatenate, zip(*found))
            order = np.argsort(t, kind="stable")
            kind, which, t, at, times = (x[order] for x in (kind, which, t, at, times))
            # whole texts together
            ends = np.append(np.flatnonzero(t[1:] != t[:-1]) + 1, len(t))
            until = np.cumsum(times)
            lo = 0
            while lo < len(t):
                base = until[lo - 1] if lo else 0
                k = np.searchsorted(until[ends - 1], base + HITS, side="right")
                hi = int(ends[k - 1]) if k and ends[k - 1] > lo else int(ends[np.searchsorted(ends, lo, side="right")])
                text, item, shift = [], [], []
                for n, (begin, of, place) in places.items():
                    some = lo + np.flatnonzero(kind[lo:hi] == n)
                    many = times[some]
                    each = np.repeat(begin[which[some]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    text.append(np.repeat(t[some], many))
                    item.append(of[each])
                    shift.append(np.repeat(at[some], many) - place[each])
                yield from _scored(b.column("id"), words, first, items, *map(np.concatenate, (text, item, shift)), ratio)
                lo = hi
    return run


def _scored(ids: pa.Array, words: np.ndarray, first: np.ndarray, items: Items, text: np.ndarray, item: np.ndarray, shift: np.ndarray, ratio: float) -> Iterator[pa.RecordBatch]:
    """Align each item with the stretches of a text around seeds that stand together; stretches that overlap are one."""
    lengths = np.array([len(w) for w in items.words])
    order = np.lexsort((shift, item, text))
    text, item, shift = text[order], item[order], shift[order]
    # edits move the seeds of a copy against each other, by one place each at most
    last = np.arange(len(text)) + items.together[item] - 1
    near = np.minimum(last, len(text) - 1)
    head = np.flatnonzero((last == near) & (text[near] == text) & (item[near] == item) & (shift[near] - shift <= items.slack[item]))
    if not len(head):
        return
    text, item, shift = text[head], item[head], shift[head]
    lo = np.maximum(shift - items.slack[item], 0)
    hi = np.minimum(shift + lengths[item] + items.slack[item], np.diff(first)[text])
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
    head = np.flatnonzero(new)
    lo, hi = lo[head], np.maximum.reduceat(hi, head)
    text, item = text[head], item[head]
    order = np.lexsort((hi - lo, lengths[item]))
    at = 0
    while at < len(order):
        width, to = 0, at
        while to < len(order) and (to == at or (to - at + 1) * max(width, hi[order[to]] - lo[order[to]] + 1) <= CELLS // 8):
            width = max(width, hi[order[to]] - lo[order[to]] + 1)
            to += 1
        some = order[at:to]
        score, end = align([items.words[k] for k in item[some]], [words[first[t] + i:first[t] + j] for t, i, j in zip(text[some], lo[some], hi[some])])
        top = MATCH * lengths[item[some]]
        good = score >= ratio * top
        some, score, end, top = some[good], score[good], end[good], top[good]
        yield pa.record_batch({"id": ids.take(pa.array(text[some])), "item_id": pa.array(items.ids[item[some]]), "score": pa.array(score.astype(np.int64)), "best": pa.array(top.astype(np.int64)), "passage_end": pa.array((lo[some] + end).astype(np.int64))})
        at = to


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """One row for each document and benchmark item of which it holds a copy: doc_id, item_id, score, best, passage_end.

    Words are compared in lower case without punctuation. An item is aligned with the document's words: 2 for an equal word, -1 for
    a changed, added or missing one. A copy reaches `ratio` of the item's best score (best); passage_end is the number of the word
    after the aligned passage.

    Every copy is aligned, wherever its edits stand: a copy of an item of L words has ratio x L equal words and so few edits that
    all but one of so many words at least are followed by the next equal one after one edit or none. Seeds are therefore
    pairs of words that are neighbours or have one word between, in the item as in the document. Of an item's words the rarest ones
    that start such pairs, by their count over all documents, are looked up: so many that any copy holds TOGETHER of them (fewer in
    short items), moved against each other by no more places than it has edits. Where a single equal word is a copy (two words or
    fewer at a ratio of a half), every word is a seed.

    Items are taken in blocks of about 8 MB of text, each broadcast and met by all documents, so a benchmark of any size does; no
    document is shuffled. Documents and items with null or empty text or without words, and items with null item_id, match
    nothing; documents with null doc_id give rows with null doc_id. Of repeated rows and several passages the best score counts,
    and the first of its ends. Empty tables give no rows. Columns other than the named ones are not looked at.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col)
    items = documents(benchmark, item_col, item_text_col).where("id is not null and t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    parts = []
    for k in range(blocks):
        got = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k).orderBy("id", "t").collect()
        block = Items([x["id"] for x in got], [x["t"] for x in got], ratio)
        known = block.all()
        if not known:
            continue
        shared = spark.sparkContext.broadcast(known)
        often = {n: np.zeros(len(v), dtype=np.int64) for n, v in known.items()}
        # at most one row for each word or pair of the block
        held = rows.mapInArrow(_counts(shared), "n int, gram long, times long").groupBy("n", "gram").agg(F.sum("times").alias("times")).toArrow()
        kind, gram, times = (held.column(c).to_numpy() for c in ("n", "gram", "times"))
        for n, x in often.items():
            x[gram[kind == n]] = times[kind == n]
        seeds = spark.sparkContext.broadcast((block, *block.seeds(known, often)))
        parts.append(rows.mapInArrow(_matches(seeds, ratio), "id long, item_id long, score long, best long, passage_end long"))
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, score long, best long, passage_end long")
    found = parts[0]
    for x in parts[1:]:
        found = found.union(x)
    top = found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "best", "passage_end")).alias("m"))
    return top.select("doc_id", "item_id", (-F.col("m.s")).alias("score"), "m.best", "m.passage_end")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a copy of an item; documents with null doc_id stay, as nothing can name them."""
    of = fresh(docs, "of")
    found = cut_lineage(benchmark_matches(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias(of)).where(F.col(of).isNotNull()).distinct())
    return docs.join(found, F.col(id_col).cast("long") == F.col(of), "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    return benchmark_matches(docs, items).withColumn("ratio", F.col("score") / F.col("best"))
