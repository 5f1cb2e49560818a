"""SimHash near-duplicates by a self-join of a binary trie of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import spans
from mnemoframe.llm.components import components
from mnemoframe.llm.tables import documents
from mnemoframe.plans.session import cut_lineage

WORDS = 3
SEED = 42
BITS = 64
#: Fingerprints that differ in at most so many bits are linked.
ERRORS = 3
#: A pair of nodes goes to a task once neither node has more fingerprints.
LEAF = 8192
#: Bits by which the tables of nodes and of pairs go down at once.
STEP = 4
#: Nodes that are broadcast; more are joined.
BROADCAST_ROWS = 200_000
#: Candidates that a task compares at once, and the product of sizes from which on a pair of nodes is compared directly.
AT_ONCE = 1 << 20
DIRECT = 48
#: Shingles whose bits are counted at once.
_NEAR = 1 << 14


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits that are set in over half of the hashes of a text's shingles, repeats included; 0 without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
        starts = np.concatenate([[0], ends[:-words]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], SEED) for i, j in zip(starts, (ends[words - 1:] - 1).tolist())]
    return _majority(np.array(hashes, dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _NEAR):
        part = hashes[at:at + _NEAR].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, "t"):
            found = np.array([fingerprint(t, words) for t in b.column("t").to_pylist()], dtype=np.uint64)
            yield pa.record_batch({"id": b.column("id"), "print": pa.array(found.view(np.int64))})
    return run


def budget(depth: int, errors: int, first: int) -> int:
    """Bits that may differ in the first `depth` ones: `first` in the upper half, `errors` in all."""
    return first if depth <= BITS // 2 else errors


class Trie:
    """Joins two sub-tries that hang at the same depth, given as ascending fingerprints, with the bits that differ above them.

    Pairs of nodes go down one bit at a time, all of a depth at once; a pair whose differing bits are over the budget is dropped
    with all that is below it. A node is a range of the fingerprints. Pairs of small nodes are compared as fingerprints.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, same: bool, depth: int, differ: int, errors: int, first: int):
        self.left, self.right, self.same, self.errors, self.first = left, right, same, errors, first
        self.depth = depth
        self.frontier = np.array([[0, len(left), 0, len(right), differ]], dtype=np.int64)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (left, right) of fingerprints within the budget."""
        nodes = self.frontier
        for depth in range(self.depth, BITS + 1):
            small = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= DIRECT if depth < BITS else np.ones(len(nodes), dtype=bool)
            yield from self._compared(nodes[small])
            nodes = nodes[~small]
            if not len(nodes):
                return
            nodes = self._below(nodes, depth)

    def _below(self, nodes: np.ndarray, depth: int) -> np.ndarray:
        """The children of pairs of nodes that stay within the budget; of a node with itself one order of its two children."""
        bit = np.uint64(1 << (BITS - 1 - depth))
        left, right = self._middle(self.left, nodes[:, 0], nodes[:, 1], bit), self._middle(self.right, nodes[:, 2], nodes[:, 3], bit)
        a, z, b, y, e = nodes.T
        itself = (a == b) & (z == y) if self.same else np.zeros(len(nodes), dtype=bool)
        parts = [
            np.stack([a, left, b, right, e], axis=1),
            np.stack([left, z, right, y, e], axis=1),
            np.stack([a, left, right, y, e + 1], axis=1),
            np.stack([left, z, b, right, e + 1], axis=1)[~itself],
        ]
        below = np.concatenate(parts)
        return below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget(depth + 1, self.errors, self.first))]

    @staticmethod
    def _middle(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
        """Where the fingerprints with the bit begin in each range, whose fingerprints agree above it."""
        base = prints[lo] & ~np.uint64(2 * int(bit) - 1)
        return np.clip(np.searchsorted(prints, base | bit), lo, hi)

    def _compared(self, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, z, b, y = nodes[:, :4].T
        rows, wide = np.repeat(np.arange(len(nodes)), z - a), y - b
        i = np.arange(len(rows)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + a[rows]
        at = 0
        ends = np.cumsum(wide[rows])
        while at < len(rows):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + AT_ONCE, side="right")))
            part, n = rows[at:to], wide[rows[at:to]]
            left = np.repeat(i[at:to], n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b[part], n)
            differ = self.left[left] ^ self.right[right]
            # the upper half has a budget of its own
            ok = (np.bitwise_count(differ) <= self.errors) & (np.bitwise_count(differ >> np.uint64(BITS // 2)) <= self.first)
            if self.same:
                ok &= left < right
            if ok.any():
                yield left[ok], right[ok]
            at = to


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each of n places is linked with, over others too."""
    least = np.arange(n)
    for a, b in links:
        while True:
            x, y = least[a], least[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = least[least]
                if np.array_equal(up, least):
                    break
                least = up
    return least


def _joined(errors: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each pair of nodes: each fingerprint with the first one of its component there."""
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("depth", "differ", "left", "right")]
            for depth, differ, left, right in zip(*columns):
                same = right is None
                sides = [np.frombuffer(x, dtype=np.uint64) for x in ([left] if same else [left, right])]
                every = np.concatenate(sides)
                shift = 0 if same else len(sides[0])
                trie = Trie(sides[0], sides[-1], same, depth, differ, errors, first)
                least = _forest(len(every), ((a, b + shift) for a, b in trie.pairs()))
                linked = np.flatnonzero(least != np.arange(len(every)))
                if len(linked):
                    yield pa.record_batch({"a": pa.array(every[least[linked]].view(np.int64)), "b": pa.array(every[linked].view(np.int64))})
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("prints")
        values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        bodies = [np.sort(values[i:j].view(np.uint64)).tobytes() for i, j in zip(at[:-1], at[1:])]
        yield pa.record_batch({"depth": b.column("depth"), "node": b.column("node"), "prints": pa.array(bodies, pa.binary())})


def _prefix(print_: str, depth: str) -> str:
    """SQL for the upper bits of a fingerprint; all of them at depth 64, none at 0."""
    return f"case when {depth} = 0 then 0L else shiftrightunsigned({print_}, {BITS} - {depth}) end"


def _links(prints: DataFrame, errors: int, first: int, leaf: int) -> DataFrame:
    """(a, b): links of the trie over a table of different fingerprints `print`; pairs above `first` errors in the upper half are not found."""
    spark = prints.sparkSession
    pairs = spark.createDataFrame([(0, 0, 0)], "u long, v long, differ int")
    ready, depth = None, 0
    while True:
        # sizes of the nodes of this depth that pairs still hold
        own = prints.select(F.expr(_prefix("print", str(depth))).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
        sized = cut_lineage(pairs.join(own.select(F.col("node").alias("u"), F.col("n").alias("un")), "u").join(own.select(F.col("node").alias("v"), F.col("n").alias("vn")), "v"))
        small = sized.where(f"un <= {leaf} and vn <= {leaf}").select("u", "v", "differ", F.lit(depth).alias("depth"))
        ready = small if ready is None else ready.unionByName(small)
        if depth == BITS or sized.where(f"un > {leaf} or vn > {leaf}").isEmpty():
            break
        big = sized.where(f"un > {leaf} or vn > {leaf}").select("u", "v", "differ")
        lower = depth + STEP
        below = prints.select(F.expr(_prefix("print", str(lower))).alias("child")).distinct().withColumn("node", F.expr(f"shiftright(child, {STEP})") if lower < BITS else F.expr(f"shiftrightunsigned(child, {STEP})"))
        # children of both nodes, 16 of each at most; of a node with itself every pair once
        down = big.join(below.select(F.col("node").alias("u"), F.col("child").alias("uc")), "u").join(below.select(F.col("node").alias("v"), F.col("child").alias("vc")), "v")
        down = down.where("u != v or uc <= vc").withColumn("differ", F.expr("differ + bit_count(uc ^ vc) - bit_count(u ^ v)").cast("int"))
        pairs = down.where(f"differ <= {budget(lower, errors, first)}").select(F.col("uc").alias("u"), F.col("vc").alias("v"), "differ")
        depth = lower
    nodes = cut_lineage(ready.select("depth", F.explode(F.array_distinct(F.array("u", "v"))).alias("node")).distinct())
    depths = sorted(str(x["depth"]) for x in nodes.select("depth").distinct().collect())
    # few nodes meet the fingerprints before these are dealt out: those of larger nodes above them never are
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    each = prints.select("print", F.explode(F.expr(f"cast(array({', '.join(depths)}) as array<int>)")).alias("depth")).withColumn("node", F.expr(_prefix("print", "depth")))
    leaves = each.join(nodes, ["depth", "node"]).groupBy("depth", "node").agg(F.collect_list("print").alias("prints"))
    leaves = cut_lineage(leaves.mapInArrow(_packed, "depth int, node long, prints binary"))
    left = leaves.select("depth", F.col("node").alias("u"), F.col("prints").alias("left"))
    right = leaves.select("depth", F.col("node").alias("v"), F.col("prints").alias("right"))
    # a node joined with itself is sent once
    alone = ready.where("u = v").join(left, ["depth", "u"]).select("depth", "differ", "left", F.lit(None).cast("binary").alias("right"))
    others = ready.where("u != v").join(left, ["depth", "u"]).join(right, ["depth", "v"]).select("depth", "differ", "left", "right")
    return alone.union(others).mapInArrow(_joined(errors, first), "a long, b long")


def near_fingerprints(prints: DataFrame, errors: int = ERRORS, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) that connect all fingerprints `print` (long) that differ in at most `errors` of 64 bits, over others too.

    The fingerprints are a binary trie. Pairs of nodes of one depth go down together from the root, adding up the bits in which they
    differ; a pair over the budget is dropped with all below it. The upper levels are tables of node pairs, four bits a step, and
    only nodes with more than `leaf` fingerprints go on; from there each pair of nodes is joined in one task, bit by bit.

    Of two halves of 32 bits, one has at most errors // 2 of the differing bits. So the trie is walked twice, with the halves in
    either order and a budget of errors // 2 for the upper half: near the root, where all nodes exist, a node then meets those
    that differ in one bit instead of three. Each task gives links to the first fingerprint of a component, never all pairs.
    """
    first = errors // 2
    swapped = prints.select(F.expr("shiftleft(print, 32) | shiftrightunsigned(print, 32)").alias("print"))
    back = [F.expr(f"shiftleft({x}, 32) | shiftrightunsigned({x}, 32)").alias(x) for x in "ab"]
    return _links(prints, errors, first, leaf).union(_links(swapped, errors, first, leaf).select(*back))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, errors: int = ERRORS, leaf: int = LEAF) -> DataFrame:
    """One row for each row of docs: doc_id (long), fingerprint (16 hex digits), component_id (long), kept boolean.

    A text's words (ASCII white space separates, A-Z count as a-z) give shingles of `words` words, repeats included, joined by a
    space; a text with fewer words is one shingle. A bit of its fingerprint is set if it is set in over half of the shingles'
    XXH64 (seed 42). Fingerprints that differ in at most `errors` bits are linked; component_id is the smallest doc_id that
    can be reached. Documents of one fingerprint are one node of the graph from the start.

    Null and empty texts, and those of white space only, have fingerprint zero, which is linked like any other. Rows of one doc_id
    are judged each by its text; a doc_id whose rows have different fingerprints links nothing by itself. A row with null doc_id
    keeps it, with a fingerprint and null component, is kept, and links nothing. Columns other than the two named ones are not
    looked at. An empty table gives no rows.
    """
    rows = cut_lineage(documents(docs, id_col, text_col).mapInArrow(_prints(words), "id long, print long"))
    classes = cut_lineage(rows.where("id is not null").groupBy("print").agg(F.min("id").alias("least")))
    links = cut_lineage(near_fingerprints(classes.select("print"), errors, leaf))
    # components of fingerprints, then the smallest doc_id of each
    found = components(links).select(F.col("node").alias("print"), F.col("component").alias("root"))
    rooted = classes.join(found, "print", "left").withColumn("root", F.coalesce("root", "print"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("print", "component_id")
    text = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    known = rows.where("id is not null").join(named, "print").select(F.col("id").alias("doc_id"), text, "component_id", F.expr("id = component_id").alias("kept"))
    return known.union(rows.where("id is null").select(F.col("id").alias("doc_id"), text, F.col("id").alias("component_id"), F.lit(True).alias("kept")))


def op13_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
