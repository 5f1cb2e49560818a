"""Exact cosine retrieval in blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..plans.split import top_n

_DIGITS = 9
#: Blocks of documents that meet a block of queries in one task; parts that a key's blocks are dealt to before they meet.
_SPAN, _SALTS = 8, 8
#: Query chunks of one matrix product; block groups whose best rows a task holds at once.
_STRIP, _OPEN = 512, 16


def vector_errors(chunks: DataFrame, identity: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Rows that make an index invalid: zero or non-finite vectors, one identity with two semantic hashes."""
    identity = list(identity)
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    bad = chunks.filter(~finite | ~F.exists(v, lambda x: x != 0)).select(*identity, F.lit("vector").alias("reason"))
    split = chunks.groupBy(*identity).agg(F.min("semantic_sha").alias("a"), F.max("semantic_sha").alias("b")).filter(
        "a <> b").select(*identity, F.lit("semantic_hash").alias("reason"))
    return bad.distinct().unionByName(split)


def _unit(rows: pa.StructArray) -> np.ndarray:
    """The vectors of a block, one a row, at length one."""
    m = rows.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by all columns, and where in it each group of equal rows starts."""
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names])
    placed = table.take(order)
    new = np.zeros(max(len(placed), 1), dtype=bool)
    new[0] = True
    for c in placed.columns:
        c = c.combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return order.to_numpy(), np.flatnonzero(new)


def _best(near: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the ``limit`` columns of each row with the least rounded distance, equal ones by column; no order."""
    n = near.shape[1]
    # rounding moves a distance by half a unit at most: what can't be among the best is left out before it
    least = np.partition(-near, limit - 1, axis=1)[:, limit - 1] if n > limit else np.full(len(near), np.nan)
    row, column = np.nonzero(~(-near > least[:, None] + 4 * 10.0 ** -_DIGITS) & (~np.isnan(near) | np.isnan(least)[:, None]))
    distance = np.round(1.0 - np.clip(near[row, column], -1.0, 1.0), _DIGITS) + 0.0
    order = np.lexsort((column, distance, row))
    row, column, distance = row[order], column[order], distance[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < limit
    return row[kept], column[kept], distance[kept]


def cosine_topk(chunks: DataFrame, queries: DataFrame, keys: Sequence[str], limit: int, block_rows: int = 4096,
                query_rows: int = 2048) -> DataFrame:
    """Top ``limit`` documents per query by minimum cosine distance over document and query chunks.

    ``chunks``: keys, kind, ref, semantic_sha, embedding. ``queries``: keys, query_ref, embedding. Vectors of a
    key are packed into blocks of bounded size by a hash, blocks are joined on the key and each pair of blocks
    is a matrix product that keeps its own best documents: a document of the overall best is among the best
    of the block that holds its nearest chunk. So memory per row is bounded and a hot key is many block pairs: blocks of documents
    are dealt to a few salts before the join, pairs are spread by a repartition, and ``_SPAN`` blocks of documents
    meet a block of queries in one task, which sends the best of all of them. Rows with a null key or name meet nothing.
    """
    keys = list(keys)
    name = ["kind", "ref", "semantic_sha"]

    def packed(df: DataFrame, cols: Sequence[str], by: Sequence[str], rows: int, out: str) -> DataFrame:
        counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).alias("__blocks"))
        placed = df.join(counts, keys).withColumn(out, F.pmod(F.xxhash64(*by), F.col("__blocks")))
        return placed.groupBy(*keys, out).agg(F.collect_list(F.struct(*cols)).alias(out + "_rows"))

    # all query chunks of one query share a block, so that their minimum is taken there
    left = packed(chunks.dropna(subset=[*keys, *name]), [*name, "embedding"], ["kind", "ref"], block_rows, "c")
    right = packed(queries.dropna(subset=[*keys, "query_ref"]), ["query_ref", "embedding"], ["query_ref"], query_rows, "q")
    left = left.withColumn("__salt", (F.floor(F.col("c") / _SPAN) % _SALTS).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.join(right, [*keys, "__salt"]).withColumn("__span", F.floor(F.col("c") / _SPAN)).repartition(parts, *keys, "q", "__span")
    key_type = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*keys).schema.fields)
    kind, ref, query = (chunks.schema["kind"].dataType.simpleString(), chunks.schema["ref"].dataType.simpleString(),
                        queries.schema["query_ref"].dataType.simpleString())
    schema = f"{key_type}, query_ref {query}, kind {kind}, ref {ref}, semantic_sha string, distance double"

    def product(docs: pa.StructArray, asks: pa.StructArray) -> pa.Table:
        who = pa.table({c: docs.field(c) for c in ["semantic_sha", "kind", "ref"]})
        by_doc, first_doc = _groups(who)
        by_ask, first_ask = _groups(pa.table({"query_ref": asks.field("query_ref")}))
        d, a = _unit(docs)[by_doc], _unit(asks)[by_ask]
        who, names = who.take(by_doc[first_doc]), asks.field("query_ref").take(pa.array(by_ask[first_ask]))
        ends, out = np.append(first_ask, len(by_ask)), []
        lo = 0
        while lo < len(first_ask):
            # whole queries, about _STRIP of their chunks at once
            hi = max(int(np.searchsorted(ends, ends[lo] + _STRIP, "right")) - 1, lo + 1)
            near = np.fmax.reduceat(d @ a[ends[lo]:ends[hi]].T, first_doc, axis=0)
            near = np.fmax.reduceat(np.ascontiguousarray(near.T), first_ask[lo:hi] - ends[lo], axis=0)
            row, column, distance = _best(near, limit)
            part = who.take(pa.array(column))
            out.append(part.append_column("query_ref", names.take(pa.array(row + lo))).append_column("distance", pa.array(distance)))
            lo = hi
        return pa.concat_tables(out)

    def cut(parts: list[pa.Table]) -> pa.Table:
        """The best of what several blocks found for the same queries."""
        if len(parts) == 1:
            return parts[0]
        t = pa.concat_tables(parts).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in ("query_ref", "distance", "semantic_sha", "kind", "ref")]))
        new = np.append(True, pc.not_equal(t["query_ref"].combine_chunks()[1:], t["query_ref"].combine_chunks()[:-1]).to_numpy(zero_copy_only=False))
        start = np.flatnonzero(new)
        return t.take(pa.array(np.flatnonzero(np.arange(len(t)) - start[np.cumsum(new) - 1] < limit)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[pa.Table]] = {}

        def sent(at: tuple) -> Iterator[pa.RecordBatch]:
            t = cut(found.pop(at))
            for position, k in enumerate(keys):
                t = t.append_column(k, pa.repeat(at[position], len(t)))
            yield from t.select([*keys, "query_ref", *["kind", "ref", "semantic_sha", "distance"]]).combine_chunks().to_batches(max_chunksize=65536)

        for b in batches:
            for i in range(b.num_rows):
                at = (*[b.column(k)[i] for k in keys], b.column("q")[i].as_py(), b.column("__span")[i].as_py())
                found.setdefault(at, []).append(product(b.column("c_rows")[i].values, b.column("q_rows")[i].values))
                if len(found[at]) == _SPAN or len(found) > _OPEN:
                    yield from sent(at if len(found[at]) == _SPAN else next(iter(found)))
        while found:
            yield from sent(next(iter(found)))

    local = pairs.select(*keys, "q", "__span", "c_rows", "q_rows").mapInArrow(blocks, schema)
    nearest = local.groupBy(*keys, "query_ref", "kind", "ref", "semantic_sha").agg(F.min("distance").alias("distance"))
    return top_n(nearest, [*keys, "query_ref"], ["distance", "semantic_sha", "kind", "ref"], limit)
