"""Plain versions of the operators on small inputs, and frames with awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

CLASHING = ("id", "t", "h", "n", "key", "node", "sig", "score", "drop", "of", "lines", "words", "length", "offset", "piece", "host", "rank", "kept", "p", "q", "a", "b")


def documents(spark, rows, lang=None):
    """(doc_id, text, lang, source, n_chars) and columns whose names operators use inside."""
    rows = [(i, t, lang[k] if lang else "en") for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.withColumn("source", F.lit("src0")).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(f"other {c}").alias(c) for c in CLASHING])


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def shingles(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def components(rows, percent=75):
    """(doc_id, n_shingles, component) of each row, by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def without_lines(rows, least=10):
    """(doc_id, text, lines, dropped) by the rule."""
    first, holders = {}, defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders[key(line)].add(i)
    for k, ids in holders.items():
        if len(k) >= least and len(ids) > 1:
            first[k] = min(ids)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or first.get(key(x), i) == i]
        out.append((i, t if len(stay) == len(lines) else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def rule_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    often = Counter(zip(w, w[1:], w[2:]))
    repeated = {k for j in range(len(w) - 2) if often[tuple(w[j:j + 3])] > 1 for k in (j, j + 1, j + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def plain(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


def leaks(rows, items, ratio=0.5):
    """{(doc_id, item_id): score} by the alignment of every pair."""
    out = {}
    for i, t in rows:
        for k, x in items:
            a, b = plain(x), plain(t)
            if a and b and (score := smith_waterman(a, b)) >= ratio * 2 * len(a):
                out[i, k] = max(score, out.get((i, k), 0))
    return out


def pieces(rows, tokenizer, capacity):
    """{(doc_id, piece): (start, length, crc)}"""
    out = {}
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for n, lo in enumerate(range(0, len(ids), capacity)):
            part = ids[lo:lo + capacity]
            out[i, n] = (lo, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    return out


def alignment(text, left, right):
    """(left ids, right ids, groups, links) of one text by the bytes of whole encodings, or None."""
    from mnemoframe.llm.tokens import byte_letters

    if not text:
        return None
    raw, letters = (" " + text).encode(), {c: b for b, c in byte_letters().items()}
    a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
    parts = [[bytes(letters[c] for c in left.id_to_token(i)) for i in a],
             [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]]
    if any(b"".join(p) != raw for p in parts):
        return None
    ends = [[sum(map(len, p[:k + 1])) for k in range(len(p))] for p in parts]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k, l = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append((a[i:k], b[j:l]))
        i, j = k, l
    starts = [[0, *e[:-1]] for e in ends]
    links = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if starts[0][x] < ends[1][y] and starts[1][y] < ends[0][x]]
    return a, b, groups, links


def alignment_rows(rows, left, right):
    found = [(i, alignment(t, left, right)) for i, t in rows]
    held = Counter(pair for _, d in found if d for pair in set(d[3]))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for i, d in found:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest()
        out.append((i, len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
    return out
