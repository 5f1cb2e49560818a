"""Fingerprints and the trie self-join against all pairs."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from mnemoframe.llm import simhash_trie  # noqa: E402


def plain_print(text):
    found = brute.words(text)
    runs = [" ".join(found[k:k + 3]) for k in range(len(found) - 2)] if len(found) >= 3 else [" ".join(found)] if found else []
    counts = [0] * 64
    for run in runs:
        h = xxhash.xxh64(run.encode(), seed=42).intdigest()
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(runs))


def plain_components(prints, errors=3):
    """The smallest id that each (id, print) reaches, by all pairs of prints."""
    least = {}
    for i, p in prints:
        least[p] = min(i, least.get(p, i))
    parent = {p: p for p in least}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = list(least)
    for k, a in enumerate(every):
        for b in every[:k]:
            if (a ^ b).bit_count() <= errors:
                parent[find(a)] = find(b)
    root = {}
    for p in every:
        root[find(p)] = min(least[p], root.get(find(p), least[p]))
    return {p: root[find(p)] for p in every}


def near_prints(n, seed):
    """Random fingerprints, chains and balls of near ones, and some that share most of their upper bits."""
    draw = random.Random(seed)
    out = [0, (1 << 64) - 1, 1, 1 << 63]
    while len(out) < n:
        p = draw.getrandbits(64)
        for _ in range(draw.choice((1, 1, 2, 6))):
            out.append(p)
            for bit in draw.sample(range(64), draw.randint(1, 4)):
                p ^= 1 << bit
    base = draw.getrandbits(64)
    return out + [base ^ draw.getrandbits(14) for _ in range(n // 3)] + [base ^ draw.getrandbits(12) << 40 for _ in range(n // 5)]


@pytest.mark.parametrize("leaf", [3, 40, 8192])
def test_trie_finds_the_links_of_all_pairs(spark, leaf):
    prints = sorted(set(near_prints(700, leaf)))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "print long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash_trie.near_fingerprints(df, leaf=leaf).collect()]
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = plain_components([(k, p) for k, p in enumerate(prints)])
    groups = Counter((find(p), want[p]) for p in prints)
    assert len(groups) == len({x for x, _ in groups}) == len({y for _, y in groups})


def test_dense_balls_stay_small():
    """All fingerprints of 12 low bits: every one has 298 neighbours, and the links are one tree."""
    prints = np.arange(1 << 12, dtype=np.uint64) << np.uint64(3)
    trie = simhash_trie.Trie(prints, prints, True, 0, 0, 3, 3)
    assert (simhash_trie._forest(len(prints), trie.pairs()) == 0).all()
    one = sum(len(a) for a, _ in simhash_trie.Trie(prints[:1 << 9], prints[:1 << 9], True, 0, 0, 3, 3).pairs())
    assert one == (1 << 9) * (9 + 36 + 84) // 2


def test_documents_equal_plain_version(spark):
    given = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = list(zip(given["doc_id"], given["text"]))
    draw = random.Random(4)
    for k in range(60):
        words = (rows[k * 3][1] or "a b c").split(" ")
        if len(words) > 30:
            words[draw.randrange(len(words))] = "changed"
        rows.append((10_000 + k, " ".join(words)))
    rows += [(20_001, None), (20_002, ""), (20_003, " \n\t"), (20_004, "One two"), (20_005, "one\x0btwo"), (None, "no id here at all"), (None, None), (7, rows[5][1]),
             (20_006, "long text again " * 20_000), (20_007, "é Ä ß ÉÄ"), (20_008, "é Ä ß ÉÄ"), (20_008, "é Ä ß ÉÄ")]
    prints = {t: plain_print(t) for _, t in rows}
    least = plain_components([(i, prints[t]) for i, t in rows if i is not None])
    want = Counter((i, f"{prints[t]:016x}", None if i is None else least[prints[t]], i is None or least[prints[t]] == i) for i, t in rows)
    got = simhash_trie.near_duplicates(brute.documents(spark, rows).repartition(4), leaf=16).select("doc_id", "fingerprint", "component_id", "kept")
    assert Counter(map(tuple, got.collect())) == want


def test_empty_table(spark):
    assert simhash_trie.near_duplicates(brute.documents(spark, [(1, "a")]).limit(0)).collect() == []
