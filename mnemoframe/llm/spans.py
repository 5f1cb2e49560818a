"""Words, lines and their 64-bit hashes over whole Arrow columns, without a Python loop over texts.

A text column is one buffer of UTF-8 bytes with offsets. Spans (words or lines) are found with byte masks; the hash of a span
comes from prefix sums of a polynomial over the bytes, so the work for a byte does not depend on the span it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_CHUNK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: fixed values: the ASCII white space \x20 \x09-\x0D
SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64 over unsigned 64-bit numbers."""
    x = x ^ np.uint64(salt & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(fold: bool) -> np.ndarray:
    """A random 64-bit number for every byte; with fold, A-Z have those of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold:
        table[65:91] = table[97:123]
    return table


CODES, FOLDED = _codes(False), _codes(True)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_FORTH = _powers(_CHUNK, _BASE)
_BACK = _powers(_CHUNK, pow(_BASE, -1, 1 << 64))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, one row at least; a batch without rows is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset:]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_set(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_SPACE = byte_set(SPACES)


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no separators, and the number of the first run of each text (one more at the end)."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between \\n, and the number of the first line of each text; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    before = np.searchsorted(breaks, offsets)
    return starts, ends, before + np.arange(len(offsets))


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at both ends; a span of white space only becomes empty at its start."""
    solid = np.flatnonzero(~_SPACE[data])
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = hi > lo
    if not len(solid):
        return starts, starts
    return np.where(some, solid[np.minimum(lo, len(solid) - 1)], starts), np.where(some, solid[np.maximum(hi, 1) - 1] + 1, starts)


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in each span: its bytes that continue no code point."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return heads[ends] - heads[starts]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap. Empty spans share one hash."""
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + _CHUNK, side="right")))
        size = int(ends[to - 1]) - lo
        if size > _CHUNK:  # a single long span
            out[at] = _long(data[lo:lo + size], codes)
        elif size:
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(codes[data[lo:lo + size]] * _FORTH[:size], out=sums[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * _BACK[np.minimum(s, _CHUNK - 1)]
        at = to
    return mix(out)


def _long(data: np.ndarray, codes: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    step = pow(_BASE, _CHUNK, 1 << 64)
    for lo in range(0, len(data), _CHUNK):
        part = data[lo:lo + _CHUNK]
        total += int(np.sum(codes[part] * _FORTH[:len(part)])) * scale
        scale = scale * step & _MASK
    return np.uint64(total & _MASK)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside each text, and the number of the first one of each text.

    A text with fewer words, but one at least, has one shingle: all its words.
    """
    counts = np.diff(first)
    windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(windows)])
    long = counts >= size
    out = np.zeros(begin[-1], dtype=np.uint64)
    if long.any():
        runs = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for k in range(size):
            runs = runs * np.uint64(_BASE) + words[k:len(words) - size + 1 + k]
        n = windows[long]
        where = np.repeat(first[:-1][long] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out[np.repeat(long, windows)] = runs[where]
    for k in np.flatnonzero((counts > 0) & ~long):
        total = int(counts[k])
        for w in words[first[k]:first[k + 1]]:
            total = (total * _BASE + int(w)) & _MASK
        out[begin[k]] = total
    return mix(out), begin
