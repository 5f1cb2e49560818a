"""Line dedup with two Bloom filters: of keys seen once, and of keys seen in a second document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import spans
from mnemoframe.llm.tables import documents, fresh
from mnemoframe.plans.session import cut_lineage

MIN_CHARS = 10
#: Each filter has 2 ** LOG_SEGMENTS segments of 2 ** log_bits bits; a key has HASHES bits in one segment.
LOG_SEGMENTS = 6
HASHES = 4
#: Bits for each line. The second filter is broadcast while it stays within MAX_BYTES; beyond that filters stay where they are
#: built, in so many segments that each has about 2 ** SEGMENT_BITS bits.
BITS_A_KEY = 10
MAX_BYTES = 64 << 20
SEGMENT_BITS = 23

#: Byte values of a second hash of a line.
_OTHER = spans.mix(spans.FOLDED, 11)
_SIGNS = spans.SPACES.decode()


def _keys(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the keys that are long enough, their hashes, their texts' numbers and their numbers in the text."""
    data, offsets = spans.buffers(texts)
    starts, ends, first = spans.line_spans(data, offsets)
    starts, ends = spans.stripped(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    number = np.arange(len(starts)) - first[text]
    long = spans.code_points(data, starts, ends) >= min_chars
    starts, ends = starts[long], ends[long]
    return data, starts, ends, spans.hashes(data, starts, ends), text[long], number[long]


def _once_a_text(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the first of equal values within each text."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return np.sort(order[new])


def _segments(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each slice of texts and each segment the lower halves of the hashes, once for each text."""
        for b in spans.slices(batches, "t", 16 << 20):
            values, text = _keys(b.column("t"), min_chars)[3:5]
            values = np.sort(values[_once_a_text(values, text)])
            edges = np.searchsorted(values, np.arange(1 << LOG_SEGMENTS, dtype=np.uint64) << np.uint64(64 - LOG_SEGMENTS))
            edges = np.append(edges, len(values)).tolist()
            low = values.astype(np.uint32)
            yield pa.record_batch({"segment": pa.array(range(1 << LOG_SEGMENTS), pa.int32()), "low": pa.array([low[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())})
    return run


def _bits(low: np.ndarray, log_bits: int) -> np.ndarray:
    """(HASHES, keys): the bits of each key, from two halves of a mixed hash."""
    mixed = spans.mix(low.astype(np.uint64), 5)
    one, two = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32) | np.uint64(1)
    return ((one + np.arange(HASHES, dtype=np.uint64)[:, None] * two) & np.uint64((1 << log_bits) - 1)).astype(np.int64)


def _filters(log_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The filter of keys seen a second time, for every segment that this task reads."""
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for b in batches:
            for segment, packed in zip(b.column("segment").to_pylist(), b.column("low").to_pylist()):
                if segment not in once:
                    once[segment], twice[segment] = (np.zeros(1 << log_bits, dtype=bool) for _ in "12")
                low, n = np.unique(np.frombuffer(packed, dtype=np.uint32), return_counts=True)
                if len(low):
                    bits = _bits(low, log_bits)
                    again = once[segment][bits].all(axis=0) | (n > 1)
                    twice[segment][bits[:, again]] = True
                    once[segment][bits] = True
        if twice:
            yield pa.record_batch({"segment": pa.array(list(twice), pa.int32()), "twice": pa.array([np.packbits(x).tobytes() for x in twice.values()], pa.binary())})
    return run


def _suspects(min_chars: int, log_bits: int, packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, key, lines): keys that the second filter holds, once for each text, with the numbers of their lines."""
        twice = {k: np.frombuffer(v, dtype=np.uint8) for k, v in packed.value.items()}
        for b in spans.slices(batches, "t"):
            data, starts, ends, values, text, number = _keys(b.column("t"), min_chars)
            segment = (values >> np.uint64(64 - LOG_SEGMENTS)).astype(np.int64)
            hit = np.zeros(len(values), dtype=bool)
            for k, bitmap in twice.items():
                own = np.flatnonzero(segment == k)
                bits = _bits(values[own].astype(np.uint32), log_bits)
                hit[own] = (bitmap[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8) & 1).all(axis=0)
            at = np.flatnonzero(hit)
            # lines of one key in one text stand together, in order
            at = at[np.lexsort((number[at], values[at], text[at]))]
            v, t = values[at], text[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
            head = np.flatnonzero(new)
            raw = data.tobytes()
            keys = [raw[i:j].lower() for i, j in zip(starts[at[head]].tolist(), ends[at[head]].tolist())]
            yield pa.record_batch({
                "id": b.column("id").take(pa.array(t[head])), "h": b.column("h").take(pa.array(t[head])), "key": pa.array(keys, pa.binary()),
                "lines": pa.ListArray.from_arrays(pa.array(np.append(head, len(at)), pa.int32()), pa.array(number[at].astype(np.int32))),
            })
    return run


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, h, hash, second, lines): each key of a text by two hashes, with the numbers of its lines."""
        for b in spans.slices(batches, "t"):
            data, starts, ends, values, text, number = _keys(b.column("t"), min_chars)
            at = np.lexsort((number, values, text))
            v, t = values[at], text[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
            head = np.flatnonzero(new)
            second = spans.hashes(data, starts, ends, _OTHER)[at[head]]
            yield pa.record_batch({
                "id": b.column("id").take(pa.array(t[head])), "h": b.column("h").take(pa.array(t[head])), "hash": pa.array(v[head].view(np.int64)), "second": pa.array(second.view(np.int64)),
                "lines": pa.ListArray.from_arrays(pa.array(np.append(head, len(at)), pa.int32()), pa.array(number[at].astype(np.int32))),
            })
    return run


def _slice_hashes(min_chars: int, log_segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each slice of texts its hashes by segment; one that several texts of the slice hold stands there twice."""
        for b in spans.slices(batches, "t", 16 << 20):
            values, text = _keys(b.column("t"), min_chars)[3:5]
            found, n = np.unique(values[_once_a_text(values, text)], return_counts=True)
            found = np.repeat(found, np.minimum(n, 2))
            segment = (found >> np.uint64(64 - log_segments)).astype(np.int64)
            edges = np.flatnonzero(np.diff(segment, prepend=-1))
            bodies = [found[i:j].tobytes() for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(found)])]
            yield pa.record_batch({"segment": pa.array(segment[edges]), "hashes": pa.array(bodies, pa.binary())})
    return run


def _segment_suspects(log_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of a segment that its second filter holds, once each; rows are sorted by segment."""
        now, bodies = None, []
        for b in batches:
            for segment, body in zip(b.column("segment").to_pylist(), b.column("hashes").to_pylist()):
                if segment != now:
                    yield from _tested(bodies, log_bits)
                    now, bodies = segment, []
                bodies.append(body)
        yield from _tested(bodies, log_bits)
    return run


def _tested(bodies: list[bytes], log_bits: int) -> Iterator[pa.RecordBatch]:
    once, twice = (np.zeros(1 << log_bits, dtype=bool) for _ in "12")
    for body in bodies:
        found, n = np.unique(np.frombuffer(body, dtype=np.uint64), return_counts=True)
        bits = _bits(spans.mix(found), log_bits)
        twice[bits[:, once[bits].all(axis=0) | (n > 1)]] = True
        once[bits] = True
    for body in bodies:
        found = np.unique(np.frombuffer(body, dtype=np.uint64))
        found = found[twice[_bits(spans.mix(found), log_bits)].all(axis=0)]
        yield pa.record_batch({"hash": pa.array(found.view(np.int64))})


def _segmented(rows: DataFrame, keys: int, min_chars: int, bits_a_key: int) -> DataFrame:
    """(id, h, hash, second, lines): the keys that the second filter holds, with filters that stay in the tasks that build them."""
    log_segments = int(max(LOG_SEGMENTS, np.ceil(np.log2(keys * bits_a_key)) - SEGMENT_BITS))
    log_bits = int(np.ceil(np.log2(max(1024, keys * bits_a_key / 2 ** log_segments))))
    hashes = rows.mapInArrow(_slice_hashes(min_chars, log_segments), "segment long, hashes binary")
    suspects = hashes.repartition("segment").sortWithinPartitions("segment").mapInArrow(_segment_suspects(log_bits), "hash long").distinct()
    lines = rows.mapInArrow(_line_hashes(min_chars), "id long, h long, hash long, second long, lines array<int>")
    return cut_lineage(lines.join(suspects, "hash", "left_semi"))


def _rewrite(text_col: str, drop_col: str, counts: bool, emptied: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with their texts less the lines named in drop_col; counts: with the lines before and the lines that went.

        Without emptied, rows go of whose text only white space stays.
        """
        for b in spans.slices(batches, text_col):
            texts, n, lost, stay = b.column(text_col).to_pylist(), [], [], []
            for k, drop in enumerate(b.column(drop_col).to_pylist()):
                gone = set(drop or ())
                n.append((texts[k] or "").count("\n") + 1)
                lost.append(len(gone))
                if gone:
                    texts[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in gone)
                stay.append(emptied or not gone or bool(texts[k].strip(_SIGNS)))
            out = {name: b.column(name) for name in b.schema.names if name != drop_col} | {text_col: pa.array(texts, pa.string())}
            out |= {"n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(lost, pa.int64())} if counts else {}
            yield pa.record_batch(out).filter(pa.array(stay, pa.bool_()))
    return run


def repeated_lines(rows: DataFrame, min_chars: int = MIN_CHARS, bits_a_key: int = BITS_A_KEY, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, h, drop array<int>): the lines of each document whose key stands in an earlier document, by rows of (id, h, t)."""
    spark = rows.sparkSession
    packed = cut_lineage(rows.mapInArrow(_segments(min_chars), "segment int, low binary"))
    keys = packed.agg(F.sum(F.length("low")) / 4).first()[0] or 0
    need = max(1024, keys * bits_a_key / 2 ** LOG_SEGMENTS)
    if need * 2 ** LOG_SEGMENTS <= max_bytes * 8:
        log_bits = int(np.ceil(np.log2(need)))
        filters = packed.repartition("segment").mapInArrow(_filters(log_bits), "segment int, twice binary")
        # 2 ** LOG_SEGMENTS rows, 2 * max_bytes together
        twice = spark.sparkContext.broadcast({int(x["segment"]): bytes(x["twice"]) for x in filters.collect()})
        found = cut_lineage(rows.mapInArrow(_suspects(min_chars, log_bits, twice), "id long, h long, key binary, lines array<int>"))
        twice.destroy()
        key = ["key"]
    else:
        found, key = _segmented(rows, int(keys), min_chars, bits_a_key), ["hash", "second"]
    # a table of its own: lines of a very common key can then be dealt to several tasks of the join
    firsts = cut_lineage(found.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select(*key, "first"))
    return found.join(firsts, key).where("id != first").groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each row of docs: doc_id, text without repeated lines, n_lines (before), n_dropped.

    Texts are split at \\n; a line's key is the line without ASCII white space at both ends and with A-Z as a-z. Keys of at
    least min_chars code points found in two documents or more lose all their lines but in the smallest doc_id that holds them;
    there all stay. Other lines stay, joined by \\n.

    The hashes of lines, 4 bytes a line and document, build two Bloom filters in segments: a key whose bits all stand in the
    first filter is set in the second one. Each task then tests its own lines against the second filter; only keys that it holds
    are shuffled, as whole keys, for the exact count and the first document. A filter has 10 bits a line. Up to max_bytes the second
    filter is broadcast. Beyond that it stays where it is built, in segments of a fixed size whose number grows with the lines:
    each segment's task names the hashes that its filter holds, lines are joined with these by their hashes (8 bytes and the
    document, no text), and 128 bits of two hashes stand for the key.

    Null text counts as empty, one empty line, and comes back as null; rows with null doc_id lose no line and make none repeated;
    rows with one doc_id are one document for the rule, so a line that only they share stays in each. Columns of docs other than
    the two named ones are not looked at. An empty table gives no rows.
    """
    rows = documents(docs, id_col, text_col).withColumn("h", F.xxhash64("t"))
    drop = repeated_lines(rows.where("id is not null"), min_chars)
    joined = rows.join(drop, ["id", "h"], "left").select("id", "t", "drop")
    out = joined.mapInArrow(_rewrite("t", "drop", True), "id long, t string, n_lines long, n_dropped long")
    return out.select(F.col("id").alias("doc_id"), F.col("t").alias("text"), "n_lines", "n_dropped")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, emptied: bool = True) -> DataFrame:
    """docs with the texts of line_dedup in text_col and all other columns as they are; null texts stay null.

    Without `emptied`, a document goes that lost lines and has nothing but white space left: all it held stands in earlier ones.
    """
    drop = repeated_lines(documents(docs, id_col, text_col).withColumn("h", F.xxhash64("t")).where("id is not null"), min_chars)
    of, h, lines = (fresh(docs, x) for x in ("of", "h", "lines"))
    drop = drop.select(F.col("id").alias(of), F.col("h").alias(h), F.col("drop").alias(lines))
    text = docs.withColumn(text_col, F.col(text_col).cast("string"))
    joined = text.join(drop, (F.col(id_col).cast("long") == F.col(of)) & (F.xxhash64(text_col) == F.col(h)), "left").drop(of, h)
    return joined.mapInArrow(_rewrite(text_col, lines, False, emptied), text.schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n
  from documents
), keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), firsts as (
  select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1
), marked as (
  select k.*, f.first is not null and f.first <> k.doc_id as gone from keyed k left join firsts f using (key)
)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
