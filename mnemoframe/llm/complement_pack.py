"""Best-fit packing by exact complements of one, two or three pieces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import tokens
from mnemoframe.llm.placement import Plan, placed
from mnemoframe.llm.tables import documents
from mnemoframe.plans.session import cut_lineage

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"


class Lengths:
    """Counts of the pieces left, with direct-address indexes of the sums that one, two or three of them reach."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pairs = np.zeros(0)
        self.index()

    def index(self) -> None:
        """Sums of two lengths that are left. Lengths only run out, so an old index names too many sums and never too few."""
        have = (self.left > 0).astype(np.float64)
        size = 1 << int(np.ceil(np.log2(2 * len(have))))
        self.pairs = np.fft.irfft(np.fft.rfft(have, size) ** 2, size)[:len(have)] > 0.5

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.left[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """The two lengths that sum up to gap, with the larger one as large as can be."""
        if gap < 2 or not self.pairs[gap]:
            return None
        low = self.left[1:gap // 2 + 1]
        high = self.left[gap - 1:gap - len(low) - 1:-1]
        both = (low > 0) & (high > 0)
        if gap % 2 == 0:
            both[-1] = low[-1] > 1
        hit = int(both.argmax()) if both.any() else -1
        return [gap - hit - 1, hit + 1] if hit >= 0 else None

    def triple(self, gap: int) -> list[int] | None:
        """Three lengths that sum up to gap, with the first as large as can be."""
        if gap < 3:
            return None
        for first in (np.flatnonzero((self.left[1:gap - 1] > 0) & self.pairs[gap - 1:1:-1]) + 1)[::-1].tolist():
            self.left[first] -= 1
            rest = self.pair(gap - first)
            self.left[first] += 1
            if rest:
                return [first, *rest]
        return None

    def exact(self, gap: int) -> list[int] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def best(self, gap: int) -> int:
        """The largest length left that fits; 0 if none does."""
        fit = np.flatnonzero(self.left[:gap + 1])
        return int(fit[-1]) if len(fit) else 0


def complement_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Fill sequences from the longest pieces down.

    The gap behind the longest piece left is filled exactly by one, two or three pieces where such a combination is left; else
    the best fitting piece goes in and the rest of the gap is tried again, until nothing fits. What was found is repeated
    as often as its pieces last, so the number of steps depends on the lengths and not on the pieces.
    """
    plan, lengths = Plan(), Lengths(counts, capacity)
    gone = 0
    for longest in range(capacity, 0, -1):
        while lengths.left[longest] > 0:
            held = [longest]
            lengths.left[longest] -= 1
            gap = capacity - longest
            while gap:
                more = lengths.exact(gap) or [lengths.best(gap)]
                if not more[0]:
                    break
                held += more
                for x in more:
                    lengths.left[x] -= 1
                gap -= sum(more)
            kinds, need = np.unique(held, return_counts=True)
            bins = 1 + int((lengths.left[kinds] // need).min())
            lengths.left[kinds] -= need * (bins - 1)
            sequence, offset = plan.open(bins), 0
            for x in kinds[::-1].tolist():
                times = held.count(x)
                plan.put(x, sequence, bins, offset, times)
                offset += x * times
            gone += int((lengths.left[kinds] == 0).sum())
            if gone > 64:
                lengths.index()
                gone = 0
    return plan


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids: its ids too.

    Documents are token ids and an end id; those over `capacity` are cut into full pieces and a last one. A plan is made from the
    number of pieces of each length (at most `capacity` numbers, whatever the size of the table) and pieces take their places by
    their rank within their length. Null and empty texts are one end id; null doc_ids and repeated rows are documents like others; an
    empty table gives no rows. Columns other than the two named ones are not looked at.
    """
    cut = cut_lineage(tokens.pieces(documents(docs, id_col, text_col), vocabulary, capacity, with_ids))
    return placed(cut, complement_plan, capacity).withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
