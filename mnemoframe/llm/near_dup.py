"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import spans
from mnemoframe.llm.components import components
from mnemoframe.llm.tables import documents, fresh
from mnemoframe.plans.session import cut_lineage

WORDS = 5
PERCENT = 75
#: A signature is CHUNKS x CHUNK minima of 16 bits.
CHUNKS = 16
CHUNK = 4
SYMBOLS = CHUNKS * CHUNK
#: Two signatures match if at most so many of their 64 symbols differ. At a similarity of 0.75 the mean is 16 with a deviation of
#: 3.5; 32 or more differ in one of 100,000 such pairs. By the pigeonhole rule 31 errors leave a chunk of 4 with one error at most.
ERRORS = 31
#: The last round also compares signatures of 2048 minima of one bit. At a similarity of 0.75 a bit differs with a chance of 1/8:
#: 256 of them with a deviation of 15. Pairs that differ in more than 320 bits are no link, but for one in 100,000.
BITS = 2048
BIT_ERRORS = 320
#: Members of a bucket that are compared as one block.
BLOCK = 256
#: Pairs for each partition of a small table of pairs.
PAIRS = 100_000
#: Rounds with leaders, at most; they end when fewer than one in WORTH tested pairs is a link.
STARS = 4
WORTH = 10

_A = spans.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
_B = spans.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64), salt=77)
_C = spans.mix(np.arange(1, BITS + 1, dtype=np.uint64), salt=78) | np.uint64(1)
_D = spans.mix(np.arange(1, BITS + 1, dtype=np.uint64), salt=79)
#: Shingles that are hashed at once, so that they stay near the processor.
_NEAR = 1 << 15


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text, sorted, all in one array, and where each text's begin."""
    data, offsets = spans.buffers(texts)
    starts, ends, first = spans.word_spans(data, offsets)
    found, begin = spans.shingle_hashes(spans.hashes(data, starts, ends), first, words)
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist()):
        found[lo:hi].sort()
    new = np.ones(len(found), dtype=bool)
    new[1:] = found[1:] != found[:-1]
    new[begin[:-1][begin[:-1] < len(found)]] = True
    return found[new], np.concatenate([[0], np.cumsum(new)])[begin]


def _per_text(values: np.ndarray, begin: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
    """ufunc.reduce over each text's values; 0 where a text has none."""
    out = np.zeros(len(begin) - 1, dtype=values.dtype)
    some = begin[1:] > begin[:-1]
    if some.any():
        out[some] = ufunc.reduceat(values, begin[:-1][some])
    return out


def signatures(found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(texts, SYMBOLS) of unsigned 16-bit numbers: for each function the middle bits of the minimum over the set."""
    out = np.zeros((len(begin) - 1, SYMBOLS), dtype=np.uint16)
    for k in range(SYMBOLS):
        out[:, k] = (_per_text(found * _A[k] + _B[k], begin, np.minimum) >> np.uint64(16)).astype(np.uint16)
    return out


def _bit_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set of shingles the middle bits of the minima under BITS functions."""
    for b in batches:
        sets = b.column("shingles")
        offsets = sets.offsets.to_numpy().astype(np.int64)
        found, begin = sets.values.to_numpy(zero_copy_only=False).view(np.uint64), offsets
        out, at = [], 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + _NEAR, side="right")) - 1)
            values, first = found[begin[at]:begin[to]], begin[at:to + 1] - begin[at]
            bits = np.zeros((to - at, BITS), dtype=bool)
            for k in range(BITS):
                bits[:, k] = _per_text(values * _C[k] + _D[k], first, np.minimum) >> np.uint64(16) & np.uint64(1)
            out += [x.tobytes() for x in np.packbits(bits, axis=1)]
            at = to
        yield pa.record_batch({"node": b.column("node"), "bits": pa.array(out, pa.binary())})


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, "t"):
            found, begin = shingle_sets(b.column("t"), words)
            sig = signatures(found, begin)
            yield pa.record_batch({
                "id": b.column("id"), "n": pa.array(np.diff(begin), pa.int64()),
                "f1": pa.array(_per_text(spans.mix(found, 1), begin, np.add).view(np.int64)), "f2": pa.array(_per_text(spans.mix(found, 2), begin, np.add).view(np.int64)),
                "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
            })
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every key of a signature: a chunk, the symbol that may be wrong, the other three symbols."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = _matrix(b.column("sig")).astype(np.int64).reshape(-1, CHUNKS, CHUNK)
        node = b.column("node").to_numpy()
        for c in range(CHUNKS):
            for j in range(CHUNK):
                x, y, z = (sig[:, c, i] for i in range(CHUNK) if i != j)
                yield pa.record_batch({"key": pa.array((c * CHUNK + j) << 48 | x << 32 | y << 16 | z), "node": pa.array(node)})


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both signatures, those with at most ERRORS differing symbols."""
    for b in batches:
        if b.num_rows:
            near = (_matrix(b.column("asig")) != _matrix(b.column("bsig"))).sum(axis=1) <= ERRORS
            yield pa.record_batch({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(near))


def _blocks(percent: int, bit_errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of two blocks of one bucket that are in different components, under the signature distance and of fitting sizes.

        A pair that meets in several buckets is given by the bucket of its first common key only.
        """
        for batch in batches:
            key = batch.column("key").to_numpy()
            left, right, same = batch.column("left"), batch.column("right"), batch.column("same").to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                sides = []
                for side in (left[i].values, right[i].values):
                    bits = np.frombuffer(b"".join(side.field("bits").to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
                    sides.append((side.field("node").to_numpy(), side.field("component").to_numpy(), side.field("n").to_numpy(), _matrix(side.field("sig")), bits))
                (an, ac, aw, asig, abits), (bn, bc, bw, bsig, bbits) = sides
                hits_a, hits_b = [], []
                for p in range(len(an)):
                    wanted = (bc != ac[p]) & (100 * np.minimum(bw, aw[p]) >= percent * np.maximum(bw, aw[p]))
                    if same[i]:
                        wanted &= bn > an[p]
                    q = np.flatnonzero(wanted)
                    if not len(q):
                        continue
                    equal = bsig[q] == asig[p]
                    ok = SYMBOLS - equal.sum(axis=1) <= ERRORS
                    q, equal = q[ok], equal[ok].reshape(-1, CHUNKS, CHUNK)
                    good = equal.sum(axis=2) >= CHUNK - 1
                    c = good.argmax(axis=1)
                    at = equal[np.arange(len(q)), c]
                    wrong = np.where(at.all(axis=1), 0, at.argmin(axis=1))
                    q = q[c * CHUNK + wrong == key[i] >> 48]
                    q = q[np.bitwise_count(bbits[q] ^ abits[p]).sum(axis=1) <= bit_errors]
                    hits_a.append(np.full(len(q), an[p]))
                    hits_b.append(bn[q])
                if hits_a:
                    a, b = np.concatenate(hits_a), np.concatenate(hits_b)
                    yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, "t"):
            found, begin = shingle_sets(b.column("t"), words)
            yield pa.record_batch({"node": b.column("id"), "shingles": pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(found.view(np.int64)))})
    return run


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}s")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("as", "bs")))
    return both.where(F.expr(f"100 * common >= {percent} * (size(as) + size(bs) - common)")).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bit_errors: int = BIT_ERRORS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, class_id, component_id (all long), kept boolean.

    Texts are sets of shingles of `words` words (ASCII white space separates, A-Z count as a-z); two texts are linked if
    100 * intersection >= percent * union. Texts of equal sets form a class, named by its smallest doc_id; classes are linked by

    1. signatures of 64 minima of 16 bits, 16 chunks of 4, each with 4 keys that leave one symbol out: all pairs with at most 31
       differing symbols share a key (pigeonhole);
    2. rounds in which every member of a bucket is paired with one leader; confirmed pairs join components, so a group of near
       copies costs a few pairs a member and not the square of its size;
    3. a last round over the buckets that still hold several components: all their pairs between different components, compared
       in blocks of about 256 members; only those under the distance leave the task, and of these only those that a longer
       signature of 2048 bits can't tell from a similarity of 0.75: of pairs of exactly that similarity one in 100,000 differs in
       more than `bit_errors` bits and is not confirmed. With bit_errors = 2048 all pairs under the first distance are confirmed.

    Every pair is confirmed on its full sets. Null and empty texts, and those of white space only, have 0 shingles and are alone.
    Equal rows fall into one class. Rows with one doc_id and different texts are judged each by its text under their common
    doc_id. A row with null doc_id is kept, with null class and component, and links nothing. Columns of docs other than the
    two named ones are not looked at. An empty table gives no rows.
    """
    rows = documents(docs, id_col, text_col)
    prints = cut_lineage(rows.mapInArrow(_sketch(words), "id long, n long, f1 long, f2 long, sig binary"))
    classes = cut_lineage(prints.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("node"), F.min("sig").alias("sig")))
    keys = classes.select("node", "sig").mapInArrow(_keys, "key long, node long")
    crowded = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    members = cut_lineage(keys.join(crowded, "key"))
    live = cut_lineage(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "n", "sig"))
    sets = cut_lineage(rows.join(live.select(F.col("node").alias("id")), "id", "left_semi").mapInArrow(_sets(words), "node long, shingles array<long>"))

    tested, links, found = None, None, None
    for turn in range(STARS):
        # a leader for each bucket: the member first in an order that changes with the round
        where = members if found is None else _open(members, found)
        order = F.struct(F.xxhash64(F.lit(turn), "node").alias("o"), F.col("node")) if turn else F.struct(F.col("node"))
        first = where.groupBy("key").agg(F.min(order)["node"].alias("lead"))
        pairs = where.join(first, "key").where("node != lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        pairs = _apart(pairs, found)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        left = live.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("sig").alias("asig"))
        right = live.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("sig").alias("bsig"))
        fit = pairs.join(left, "a").join(right, "b").where(f"100 * least(an, bn) >= {percent} * greatest(an, bn)")
        fit = cut_lineage(fit.select("a", "asig", "b", "bsig").mapInArrow(_close, "a long, b long"))
        good = cut_lineage(_confirmed(sets, fit, percent))
        tried, gained = fit.count(), good.count()
        fit, good = fit.coalesce(1 + tried // PAIRS), good.coalesce(1 + gained // PAIRS)
        tested = fit if tested is None else tested.union(fit)
        links = good if links is None else links.union(good)
        if gained * WORTH < tried or not gained:
            # what is left are texts that share a part: the last round has them all
            break
        found = cut_lineage(components(links))

    rest = _open(members, found) if found is not None else members
    own = F.col("component") if "component" in rest.columns else F.col("node")
    rest = cut_lineage(rest.select("key", "node", own.alias("component")))
    bits = sets.join(rest.select("node").distinct(), "node", "left_semi").mapInArrow(_bit_signatures, "node long, bits binary")
    rest = rest.join(live.join(bits, "node"), "node").select("key", "node", "component", "n", "sig", "bits")
    size = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = rest.join(size, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).groupBy("key", "block")
    blocks = cut_lineage(blocks.agg(F.collect_list(F.struct("node", "component", "n", "sig", "bits")).alias("members")))
    left = blocks.select("key", F.col("block").alias("x"), F.col("members").alias("left"))
    right = blocks.select("key", F.col("block").alias("y"), F.col("members").alias("right"))
    pairs = left.join(right, "key").where("x < y or x = y and size(left) > 1").select("key", "left", "right", F.expr("x = y").alias("same"))
    pairs = pairs.mapInArrow(_blocks(percent, bit_errors), "a long, b long").distinct()
    pairs = cut_lineage(pairs.join(tested, ["a", "b"], "left_anti"))
    found = components(links.union(_confirmed(sets, pairs, percent)))
    named = classes.join(found, "node", "left").select("n", "f1", "f2", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id"))
    return _result(prints, named)


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with the component."""
    now = members.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return now.join(mixed, "key")


def _apart(pairs: DataFrame, found: DataFrame | None) -> DataFrame:
    """Pairs of different components."""
    if found is None:
        return pairs
    a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"{x}c")) for x in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(ac, a) != coalesce(bc, b)").select("a", "b")


def _result(prints: DataFrame, named: DataFrame) -> DataFrame:
    alone = prints.where("n = 0 or id is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    joined = prints.where("n > 0 and id is not null").join(named, ["n", "f1", "f2"])
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", "component_id", F.expr("id = component_id").alias("kept")).union(alone)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that near_duplicates doesn't keep; one of each group stays, with all its columns.

    Documents with null doc_id stay; of a repeated doc_id all rows stay or go.
    """
    of = fresh(docs, "of")
    lost = cut_lineage(near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias(of)).distinct())
    return docs.join(lost, F.col(id_col).cast("long") == F.col(of), "left_anti")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
