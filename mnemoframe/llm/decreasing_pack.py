"""Best-fit-decreasing packing with a segment tree of capacities, and the packed matrices."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import tokens
from mnemoframe.llm.placement import Plan, placed
from mnemoframe.llm.tables import documents
from mnemoframe.plans.session import cut_lineage

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
PAD = 0


class CapacityTree:
    """How many open sequences have each free capacity, with the search for the tightest one that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << int(capacity).bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: dict[int, deque[tuple[int, int]]] = {}

    def add(self, free: int, sequence: int, bins: int) -> None:
        """`bins` sequences, numbered from `sequence` on, with `free` places each."""
        if bins and free:
            self.open.setdefault(free, deque()).append((sequence, bins))
            self._change(free, bins)

    def _change(self, free: int, by: int) -> None:
        node = self.leaves + free
        while node:
            self.counts[node] += by
            node >>= 1

    def tightest(self, length: int) -> int:
        """The smallest free capacity of an open sequence that is `length` or more; 0 if none."""
        node = self.leaves + length
        if self.counts[node]:
            return length
        while node > 1:
            if not node & 1 and self.counts[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.counts[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return 0

    def take(self, free: int, most: int) -> tuple[int, int]:
        """Up to `most` sequences with that capacity, numbered one after the other."""
        sequence, bins = self.open[free].popleft()
        if bins > most:
            self.open[free].appendleft((sequence + most, bins - most))
            bins = most
        self._change(free, -bins)
        return sequence, bins


def decreasing_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing: the longest pieces first, each into the tightest open sequence that holds it, else into a new one.

    Pieces of one length are placed together: a sequence with room for q of them gets q before the next one is looked at, as best
    fit does piece by piece, since after each piece it is the tightest of all that still fit.
    """
    plan, tree = Plan(), CapacityTree(capacity)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = tree.tightest(length)
            times = (free or capacity) // length
            bins, times = (left // times, times) if left >= times else (1, left)
            if free:
                sequence, bins = tree.take(free, bins)
            else:
                free, sequence = capacity, plan.open(bins)
            plan.put(length, sequence, bins, capacity - free, times)
            left -= bins * times
            tree.add(free - times * length, sequence, bins)
    return plan


def _rows(capacity: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequences from pieces that come ordered by (sequence_id, offset); holds one sequence at a time."""
        now: tuple[int, list, list] | None = None
        for b in batches:
            done = []
            names = ("sequence_id", "id", "length", "ids", "narrow")
            for sequence, doc, length, ids, narrow in zip(*(b.column(n).to_pylist() for n in names)):
                if now is None or now[0] != sequence:
                    if now is not None:
                        done.append(now)
                    now = (sequence, [], [])
                now[1].append(doc)
                now[2].append(tokens.unpacked(ids, narrow))
                if len(done) >= 256:
                    yield _matrix(done, capacity, pad)
                    done = []
            if done:
                yield _matrix(done, capacity, pad)
        if now is not None:
            yield _matrix([now], capacity, pad)
    return run


def _matrix(done: list, capacity: int, pad: int) -> pa.RecordBatch:
    ids = np.full((len(done), capacity), pad, dtype="<u4")
    positions = np.zeros((len(done), capacity), dtype="<u4")
    ends, docs = [], []
    for k, (_, names, parts) in enumerate(done):
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        ids[k, :cuts[-1]] = np.concatenate(parts)
        positions[k, :cuts[-1]] = np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts))
        ends.append(cuts.astype(np.int32))
        docs.append(names)
    return pa.record_batch({
        "sequence_id": pa.array([x[0] for x in done], pa.int64()), "doc_ids": pa.array(docs, pa.list_(pa.int64())),
        "cu_seqlens": pa.array([x.tolist() for x in ends], pa.list_(pa.int32())),
        "input_ids": pa.array([x.tobytes() for x in ids], pa.binary()), "position_ids": pa.array([x.tobytes() for x in positions], pa.binary()),
    })


def packed_matrices(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, pad: int = PAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each sequence: sequence_id, doc_ids, cu_seqlens, input_ids, position_ids.

    input_ids and position_ids are rows of matrices with `capacity` little-endian unsigned 32-bit numbers; behind the last piece
    stand `pad` and 0. cu_seqlens holds 0 and the end of every piece; positions begin at 0 with each piece. Documents longer
    than `capacity` are cut into pieces without loss: the ids of a document's pieces, in the order of their places in the
    document (see pack_decreasing), are its ids. Null and empty texts are one end id; null doc_ids and repeated rows are
    documents like others; an empty table gives no rows. Columns other than the two named ones are not looked at.
    """
    cut, places = pack_decreasing(docs, vocabulary, capacity, id_col, text_col)
    narrow = places.select(F.col("part").alias("p"), F.col("place").alias("q"), "sequence_id", "offset")
    full = cut.join(narrow, F.expr("part = p and place = q")).select("sequence_id", "offset", "id", "length", "ids", "narrow")
    ordered = full.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return ordered.mapInArrow(_rows(capacity, pad), "sequence_id long, doc_ids array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary")


def pack_decreasing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pieces with their ids, and the places of the pieces: (part, place) names a piece, with id, piece, start, length, sequence_id, offset."""
    cut = tokens.pieces(documents(docs, id_col, text_col), vocabulary, capacity, with_ids=True)
    # numbers that are fixed with the rows as the table is written
    number = F.monotonically_increasing_id()
    cut = cut_lineage(cut.withColumn("number", number).withColumn("part", F.shiftright("number", 33)).withColumn("place", F.col("number").bitwiseAND((1 << 33) - 1)).drop("number"))
    return cut, placed(cut.select("id", "piece", "start", "length", "part", "place"), decreasing_plan, capacity, key=("part", "place"))


def write_matrices(packed: DataFrame, path: str) -> None:
    """Packed sequences as Parquet files: matrices as rows of bytes, lengths as lists."""
    packed.write.mode("errorifexists").parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = b.column("cu_seqlens").to_pylist()
        crc = {n: pa.array([zlib.crc32(x) for x in b.column(m).to_pylist()], pa.int64()) for n, m in (("ids_crc32", "input_ids"), ("positions_crc32", "position_ids"))}
        yield pa.record_batch({"sequence_id": b.column("sequence_id"), "n_pieces": pa.array([len(x) - 1 for x in ends], pa.int64()), "n_tokens": pa.array([x[-1] for x in ends], pa.int64()),
                               "doc_ids": b.column("doc_ids"), "cu_seqlens": b.column("cu_seqlens")} | crc)


def op6_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed sequence, with CRC-32 of its rows of ids and positions in place of these."""
    import public_tokenizers

    packed = packed_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
    return packed.mapInArrow(_digests, "sequence_id long, n_pieces long, n_tokens long, doc_ids array<long>, cu_seqlens array<int>, ids_crc32 long, positions_crc32 long")
