"""Cross-tokenizer alignment: spans of two tokenizers as coarse cuts, refined inside characters by the tokens' bytes."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoframe.llm import spans
from mnemoframe.llm.tables import documents
from mnemoframe.llm.tokens import byte_letters
from mnemoframe.plans.session import cut_lineage

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Texts whose links are counted together before any shuffle; a chunk's pairs and counts meet its documents again later.
CHUNK_BYTES = 16 << 20
#: Units that a worker keeps, twice at most, besides those of its present texts, and the longest that it keeps.
CACHED_UNITS = 150_000
CACHED_CHARS = 48
#: Characters of texts whose new units are aligned together, and of units in one call.
LEARN_CHARS = 1 << 20
BATCH_CHARS = 1 << 16
#: A link's code is the left id times 2 ** 32 and the right id.
SHIFT = 32

#: fixed value: how a piece writes a space
_SPACE_MARK = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: a single space between characters that are no white space: no token of either side reaches across its left end
_UNIT = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r" \s|\s ")


class Unit(tuple):
    """(left tokens, right tokens, groups, text of the groups, packed codes of the links), or None where bytes differ."""


class Aligner:
    """Aligns space + text as two tokenizers cut it.

    Where the left one splits at white space as byte-level BPE does, and no piece of the right one holds a space behind another
    character, a text is cut into units at single spaces: both tokenizers end a token there, so units are encoded alone and kept.
    With other tokenizers a text is one unit.
    """

    def __init__(self, left: str, right: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(left)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        letters = {c: b for b, c in byte_letters().items()}
        self.left_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.left.get_vocab().items()}
        names = [self.right.id_to_piece(i) for i in range(self.right.get_piece_size())]
        self.right_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(x)) and self.right.is_byte(i) else x.replace(_SPACE_MARK, " ").encode() for i, x in enumerate(names)]
        self.left_size = np.zeros(max(self.left_bytes) + 1, dtype=np.int64)
        self.left_size[list(self.left_bytes)] = [len(x) for x in self.left_bytes.values()]
        self.right_byte = np.array([self.right.is_byte(i) for i in range(len(names))])
        # decimal digits of every id, with room for a mark, and how many there are
        most = max(max(self.left_bytes), len(names)) + 1
        self.digits = np.zeros((most, len(str(most)) + 1), dtype=np.uint8)
        self.width = np.array([len(str(i)) for i in range(most)])
        for i in range(most):
            self.digits[i, :self.width[i]] = bytearray(str(i).encode())
        self.right_size = np.array([len(x) for x in self.right_bytes], dtype=np.int64)
        rules = json.loads(Path(left).read_text())
        steps = rules.get("pre_tokenizer") or {}
        self.by_unit = (rules.get("normalizer") is None and steps.get("type") == "ByteLevel" and steps.get("use_regex") is True and steps.get("add_prefix_space") is False
                        and not any(x["lstrip"] or x["rstrip"] or not x["special"] for x in rules.get("added_tokens", []))
                        and not any(_SPACE_MARK in x.lstrip(_SPACE_MARK) for x in names)
                        and self.right.encode("a  b", out_type=str)[:2] == [_SPACE_MARK + "a", _SPACE_MARK])
        self.units: dict[str, Unit | None] = {}
        self.older: dict[str, Unit | None] = {}

    def split(self, text: str) -> list[str]:
        if not self.by_unit:
            return [text]
        if text[0] != " " and text[-1] != " " and not _ODD_SPACE.search(text):
            return text.split(" ")
        return _UNIT.split(text)

    def aligned(self, units: list[str]) -> "Aligned":
        text = " ".join(units)
        return Aligned(self, units, text, self.left.encode(" " + text, add_special_tokens=False))

    def learn(self, units: list[str]) -> None:
        """Aligns units: those that may stand side by side in one text by one call for many, the others alone."""
        joined, size = [], 0
        for unit in units:
            if _SPACE_MARK in unit:
                # the right side reads the mark as a space
                self.units[unit] = None
            elif not unit or unit[0].isspace() or unit[-1].isspace():
                self.units[unit] = self.aligned([unit]).units()[0]
            else:
                joined.append(unit)
                size += len(unit)
                if size >= BATCH_CHARS:
                    self.units.update(zip(joined, self.aligned(joined).units()))
                    joined, size = [], 0
        if joined:
            self.units.update(zip(joined, self.aligned(joined).units()))

    def documents(self, texts: list[str | None]) -> Iterator[list[Unit] | None]:
        """For each text the alignments of its units in order; None where it has no tokens. New units of many texts are aligned together."""
        at = 0
        while at < len(texts):
            parts, size = [], 0
            while at < len(texts) and size < LEARN_CHARS:
                parts.append(self.split(texts[at]) if texts[at] else [])
                size += len(texts[at] or "")
                at += 1
            used = set(chain.from_iterable(parts))
            if len(self.units) > CACHED_UNITS:
                # units that no text has used since the last time go
                self.older, self.units = self.units, {}
            for unit in used & self.older.keys() - self.units.keys():
                self.units[unit] = self.older[unit]
            self.learn([u for u in used if u not in self.units])
            for units in parts:
                found = list(map(self.units.__getitem__, units))
                yield None if None in found or not found else found
            for unit in used:
                if len(unit) > CACHED_CHARS:
                    del self.units[unit]

    def groups(self, text: str | None) -> list[tuple[int, int, list[int], list[int]]]:
        """(start, end, left ids, right ids) of every group, in bytes of space + text."""
        return self.aligned(self.split(text)).groups() if text else []


class Aligned:
    """The alignment of units (each with a space before it), all at once; arrays run over the units' tokens in order.

    Where the tokens' bytes are the text's, their lengths say where each ends and no spans are asked for. Else one odd unit must not
    move the others: ends of the tokenizers' spans are the coarse cuts: characters for the left side, bytes for the right one. A character of several
    bytes may hold many tokens whose spans all end with it; there the tokens' own bytes say where each ends.
    """

    def __init__(self, aligner: Aligner, units: list[str], text: str, left):
        raw = "".join(" " + u for u in units).encode()
        data = np.frombuffer(raw, dtype=np.uint8)
        heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        self.digits, self.width = aligner.digits, aligner.width
        self.start = heads[np.concatenate([[0], np.cumsum([len(u) + 1 for u in units])])]
        a, b = left.ids, aligner.right.encode(text)
        self.a, self.b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        if b"".join(map(aligner.left_bytes.__getitem__, a)) == raw == b"".join(map(aligner.right_bytes.__getitem__, b)):
            self.a_end, self.b_end = np.cumsum(aligner.left_size[self.a]), np.cumsum(aligner.right_size[self.b])
        else:
            self._by_spans(aligner, left, aligner.right.encode(text, return_type="proto"), heads, len(data))
        self.a_cut, self.b_cut = np.isin(self.a_end, self.b_end), np.isin(self.b_end, self.a_end)
        self.a_first, self.b_first = (np.searchsorted(x, self.start, side="right") for x in (self.a_end, self.b_end))
        self.same = self._as_bytes(aligner.left_bytes, aligner.left_size, self.a, self.a_first, raw) & self._as_bytes(aligner.right_bytes, aligner.right_size, self.b, self.b_first, raw)

    def _by_spans(self, aligner: Aligner, left, right, heads: np.ndarray, size: int) -> None:
        pieces = list(right.pieces)
        begin, end = np.array([p.begin for p in pieces], dtype=np.int64), np.array([p.end for p in pieces], dtype=np.int64)
        # the spans of a character's bytes are empty but for the last one
        whole = np.flatnonzero(~(aligner.right_byte[self.b] & (begin == end)))
        if len(whole):
            end = end[whole[np.minimum(np.searchsorted(whole, np.arange(len(end))), len(whole) - 1)]]
        self.a_end = _refined(heads[np.array([e for _, e in left.offsets], dtype=np.int64)], aligner.left_size[self.a])
        self.b_end = _refined(np.minimum(end + 1, size), aligner.right_size[self.b])

    def _as_bytes(self, table, sizes: np.ndarray, ids: np.ndarray, first: np.ndarray, raw: bytes) -> np.ndarray:
        """For each unit whether the bytes of its tokens are the unit's."""
        if b"".join(map(table.__getitem__, ids.tolist())) == raw and np.array_equal(np.concatenate([[0], np.cumsum(sizes[ids])])[first], self.start):
            return np.ones(len(first) - 1, dtype=bool)
        parts = [table[i] for i in ids.tolist()]
        return np.array([b"".join(parts[i:j]) == raw[lo:hi] for i, j, lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), self.start[:-1].tolist(), self.start[1:].tolist())])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all pairs of tokens whose bytes overlap, and the number of the first one of each left token."""
        a_from = np.concatenate([[0], self.a_end[:-1]]) if len(self.a) else self.a
        lo = np.searchsorted(self.b_end, a_from, side="right")
        hi = np.minimum(np.searchsorted(self.b_end, self.a_end, side="left") + 1, len(self.b))
        n = np.maximum(hi - lo, 0)
        first = np.concatenate([[0], np.cumsum(n)])
        right = np.arange(first[-1]) - np.repeat(first[:-1] - lo, n)
        return np.repeat(self.a, n) << SHIFT | self.b[right], first

    def units(self) -> list[Unit | None]:
        """One for each unit."""
        codes, first = self.links()
        packed, link_first = codes.tobytes(), 8 * first[self.a_first]
        # texts: the left ids of each group, then its right ids, each with the mark behind it
        a_group, b_group = (np.cumsum(x) - x for x in (self.a_cut, self.b_cut))
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        ids = np.concatenate([self.a, self.b])[order]
        cells, width = self.digits[ids], self.width[ids]
        cells[np.arange(len(ids)), width] = np.concatenate([np.where(self.a_cut, ord("|"), ord(",")), np.where(self.b_cut, ord(";"), ord(","))])[order]
        text = cells[np.arange(cells.shape[1]) <= width[:, None]].tobytes()
        text_first = np.concatenate([[0], np.cumsum(width + 1)])[self.a_first + self.b_first].tolist()
        n_groups = np.concatenate([[0], np.cumsum(self.a_cut)])[self.a_first]
        counts = np.stack([np.diff(self.a_first), np.diff(self.b_first), np.diff(n_groups)], axis=1).tolist()
        edges = link_first.tolist()
        return [Unit((*n, text[i:j - 1], packed[lo:hi])) if same else None
                for n, i, j, lo, hi, same in zip(counts, text_first[:-1], text_first[1:], edges[:-1], edges[1:], self.same.tolist())]

    def groups(self) -> list[tuple[int, int, list[int], list[int]]]:
        """Groups of all units as one text; none where bytes differ."""
        if not self.same.all():
            return []
        a_at, b_at = (np.concatenate([[0], np.flatnonzero(x) + 1]).tolist() for x in (self.a_cut, self.b_cut))
        a, b, ends = self.a.tolist(), self.b.tolist(), [0, *self.a_end[self.a_cut].tolist()]
        return [(lo, hi, a[i:k], b[j:l]) for lo, hi, i, k, j, l in zip(ends[:-1], ends[1:], a_at[:-1], a_at[1:], b_at[:-1], b_at[1:])]


def _refined(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens in bytes: the span's end where the next token's span ends later, else by the tokens' bytes since the last cut."""
    if not len(coarse):
        return coarse
    last = np.append(coarse[1:] > coarse[:-1], True)
    # tokens of a run that ends in one place: its first one starts where the run before it ended
    head = np.concatenate([[True], last[:-1]])
    run = np.cumsum(head) - 1
    begin = np.concatenate([[0], coarse[last][:-1]])[run]
    total = np.cumsum(sizes)
    inside = total - (total - sizes)[head][run]
    return np.where(last, coarse, np.minimum(begin + inside, coarse))


@lru_cache(1)
def aligner_of(left: str, right: str) -> Aligner:
    """The aligner of a worker process, with the units that it has met."""
    return Aligner(left, right)


#: kind 0: the codes of a chunk's links; kind 1: a document.
_CHUNKS = "kind int, chunk long, at int, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, packed binary"


def _chunks(left: str, right: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's documents, with places in its list of distinct links and how often each stands there, and that list."""
        aligner, chunk = aligner_of(left, right), TaskContext.get().partitionId() << 32
        for b in spans.slices(batches, "t", CHUNK_BYTES):
            rows, lists = [], []
            for found in aligner.documents(b.column("t").to_pylist()):
                if found is None:
                    rows.append((0, 0, 0, 0, ""))
                    lists.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    continue
                n_a, n_b, n_groups, texts, packed = zip(*found)
                codes = np.frombuffer(b"".join(packed), dtype=np.int64)
                rows.append((sum(n_a), sum(n_b), sum(n_groups), len(codes), hashlib.sha256(b";".join(texts)).hexdigest()))
                lists.append(np.unique(codes, return_counts=True))
            every, held = np.unique(np.concatenate([x for x, _ in lists]), return_counts=True)
            packed = [_pack(np.searchsorted(every, x), n) for x, n in lists]
            n = len(rows)
            columns = list(zip(*rows))
            yield _record(np.ones(n, np.int32), np.full(n, chunk), np.arange(n, dtype=np.int32), b.column("id"), *columns, packed)
            # parts of the list, so that no cell grows with the chunk
            for part, at in enumerate(range(0, len(every), 1 << 16)):
                body = every[at:at + (1 << 16)].tobytes() + held[at:at + (1 << 16)].astype(np.int64).tobytes()
                yield _record([0], [chunk], [part << 16], [None], [0], [0], [0], [0], [""], [body])
            chunk += 1
    return run


def _record(*columns) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ("kind", "chunk", "at", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "packed")
    return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types)], names=names)


def _pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places as steps, and counts; deflated."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes() + counts.astype("<u4").tobytes(), 1)


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(body), dtype="<u4").astype(np.int64)
    return np.cumsum(both[:len(both) // 2]), both[len(both) // 2:]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each link code of a chunk, with the number of its documents that hold it."""
    for b in batches:
        for chunk, at, body in zip(b.column("chunk").to_pylist(), b.column("at").to_pylist(), b.column("packed").to_pylist()):
            both = np.frombuffer(body, dtype=np.int64)
            n = len(both) // 2
            yield pa.record_batch({"link": pa.array(both[:n]), "chunk": pa.array(np.full(n, chunk)), "at": pa.array(np.arange(at, at + n, dtype=np.int32)), "held": pa.array(both[n:])})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their sums; rows are sorted so that a chunk's counts, in order of their places, stand before its documents."""
    counts, best = [], []
    now, table = None, None
    for b in batches:
        kinds, chunks = b.column("kind").to_numpy(), b.column("chunk").to_numpy()
        edges = np.flatnonzero((kinds[1:] != kinds[:-1]) | (chunks[1:] != chunks[:-1])) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
            part = b.slice(lo, hi - lo)
            if chunks[lo] != now:
                now, table, counts, best = chunks[lo], None, [], []
            if kinds[lo] == 0:
                counts.append(part.column("total").to_numpy())
                best.append(part.column("best").to_numpy(zero_copy_only=False))
                continue
            if table is None:
                table = np.concatenate(counts) if counts else np.zeros(0, np.int64), np.concatenate(best) if best else np.zeros(0, bool)
            n_best, total = [], []
            for body in part.column("packed").to_pylist():
                places, times = _unpack(body)
                n_best.append(int(times[table[1][places]].sum()))
                total.append(int((times * table[0][places]).sum()))
            kept = {k: part.column(k) for k in ("id", "n_a", "n_b", "n_groups", "n_links")}
            yield pa.record_batch(kept | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": part.column("groups_sha256")})


def link_counts(chunks: DataFrame) -> DataFrame:
    """(link, total, best): how many documents hold each pair of ids linked, and whether that is its left id's highest."""
    totals = chunks.groupBy("link").agg(F.sum("held").alias("total"))
    # a left id has no more pairs than the right vocabulary has ids
    highest = F.max("total").over(Window.partitionBy(F.shiftright("link", SHIFT)))
    return totals.select("link", "total", (F.col("total") == highest).alias("best"))


def alignment_summary(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    Space + text is cut by the left (a tokenizers file) and by the right tokenizer (a sentencepiece model, which adds the space itself);
    places where tokens of both end cut it into groups, and all pairs of tokens whose bytes overlap are links. A link's count is
    the number of documents of the whole table that hold its pair of ids. n_best: links whose count is the highest of their left
    id, ties included; count_sum: the sum over links; groups_sha256: of `a1,a2|b1;a3|b2,b3`.

    Each task aligns its documents once and keeps, for about 16 MB of text (a chunk), the distinct links and each document's places in
    that list. Counts are summed over chunks, and each chunk gets back the counts of its own links: nothing is broadcast, texts are
    not shuffled, and the shuffled rows are distinct links of chunks, not of documents.

    Null and empty texts, and texts that either tokenizer does not give back byte by byte, have zeros and an empty string. Repeated
    rows, also of one doc_id, are documents of their own and count each; rows with null doc_id count too and keep it. Columns
    other than the two named ones are not looked at. An empty table gives no rows.
    """
    found = cut_lineage(documents(docs, id_col, text_col).mapInArrow(_chunks(left, right), _CHUNKS))
    listed = found.where("kind = 0").select("chunk", "at", "packed").mapInArrow(_listed, "link long, chunk long, at int, held long")
    counted = listed.select("link", "chunk", "at").join(link_counts(listed), "link")
    looked_up = counted.select(F.lit(0).alias("kind"), "chunk", "at", "total", "best")
    rows = found.where("kind = 1").drop("kind").withColumn("kind", F.lit(1))
    both = looked_up.unionByName(rows, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind", "at")
    out = both.mapInArrow(_summed, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", "doc_id")


def aligned_groups(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): the groups of each document in order, as structs of start and end in bytes of space + text and the ids of both sides.

    No groups where alignment_summary has zeros. No row is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(left, right)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("left_ids", pa.list_(pa.int32())), ("right_ids", pa.list_(pa.int32()))]))
        for b in spans.slices(batches, "t"):
            groups = [[dict(zip(("start", "end", "left_ids", "right_ids"), g)) for g in aligner.groups(t)] for t in b.column("t").to_pylist()]
            yield pa.record_batch({"id": b.column("id"), "groups": pa.array(groups, kind)})

    out = documents(docs, id_col, text_col).mapInArrow(run, "id long, groups array<struct<start long, end long, left_ids array<int>, right_ids array<int>>>")
    return out.withColumnRenamed("id", "doc_id")


def op12_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_summary(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(LEFT), public_tokenizers.path(RIGHT))
