"""The query of the quality classifier against a plain version of every step."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from mnemoframe.llm import quality_model, spans  # noqa: E402

LOUD, SYMBOLS = "#*$%&|<>!~^=_", "#*$%&|<>"


def wordy(c):
    return c.isascii() and c.isalnum() or ord(c) >= 128


def plain_votes(text):
    raw = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", raw)
    low = [w.encode().lower() for w in words]
    n, size = len(words), len(raw.encode())
    letters = sum(c.isascii() and c.isalpha() for c in raw)
    bare = [not any(wordy(c) for c in w) for w in words]
    runs = [tuple(low[k:k + 3]) for k in range(n - 2)] if n >= 3 else [tuple(low)] if n else []
    lines = [x for x in (line.strip(" \t\n\x0b\x0c\r").encode().lower() for line in raw.split("\n")) if x]
    few = n < 10
    loud = sum(not b and w[-1] in LOUD for w, b in zip(words, bare))
    shares = [
        (sum(c in SYMBOLS for c in raw) / max(size, 1), n == 0),
        (sum("A" <= c <= "Z" for c in raw) / max(letters, 1), letters < 30),
        (loud / max(n, 1), few),
        (sum(bare) / max(n, 1), few),
        ((len(runs) - len(set(runs))) / max(len(runs), 1), few),
        ((len(lines) - len(set(lines))) / max(len(lines), 1), len(lines) < 4),
        (sum(a == b for a, b in zip(low, low[1:])) / max(n, 1), few),
    ]
    return "".join("2" if silent else "0" if x >= bad else "1" if x <= good else "2" for (x, silent), (_, bad, good) in zip(shares, quality_model.LABELLERS))


def plain_em(patterns):
    post = {p: 0.2 ** p.count("0") if "0" in p else 0.95 if "1" in p else 0.5 for p in patterns}
    for _ in range(60):
        chance = []
        for k in range(7):
            count = [[1.0, 1.0], [1.0, 1.0]]
            for p, n in patterns.items():
                if p[k] != "2":
                    count[0][int(p[k])] += n * (1 - post[p])
                    count[1][int(p[k])] += n * post[p]
            chance.append([[x / sum(c) for x in c] for c in count])
        total = sum(patterns.values())
        prior = (sum(n * post[p] for p, n in patterns.items()) + 1) / (total + 2)
        new = {}
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[k][1][int(v)]) - math.log(chance[k][0][int(v)]) for k, v in enumerate(p) if v != "2")
            new[p] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
        done = max(abs(new[p] - post[p]) for p in patterns) < 1e-6
        if done:
            break
        post = new
    return post


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out, before = Counter(), None
    for w in words:
        raw = w.encode()
        h = int(spans.hashes(np.frombuffer(raw, dtype=np.uint8), np.array([0]), np.array([len(raw)]))[0])
        byte_wordy = lambda b: b >= 128 or chr(b).isalnum()
        kind = 1 if 65 <= raw[0] <= 90 else 0 if byte_wordy(raw[0]) else raw[0]
        second = raw[min(1, len(raw) - 1)]
        shape = (((kind << 8 | (0 if byte_wordy(raw[-1]) else raw[-1])) << 4 | min(len(raw), 15)) << 2) | (h == before) << 1 | (65 <= second <= 90)
        mask = (1 << quality_model.LOG_FEATURES) - 1
        out[h & mask] += 1
        out[int(spans.mix(np.array([shape], dtype=np.uint64), 9)[0]) & mask] += 1
        before = h
    return out, len(words)


def some_rows():
    draw = random.Random(3)
    good = ["the river runs past the old mill and", "no one had seen her since the day", "Rain fell on the roof, and he slept."]
    rows = []
    for k in range(90):
        text = " ".join(draw.choice(good) + f" w{draw.randrange(300)}" for _ in range(draw.randint(1, 12)))
        if k % 4 == 0:
            text = " ".join(w + draw.choice(["###", "$$$", "!!!", ""]) for w in text.split())
        if k % 9 == 0:
            text = "BUY NOW \n" * draw.randint(1, 20) + text.upper()
        rows.append((k, text))
    return rows + [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "# # # | |"), (None, "no id but words"), (7, rows[3][1]), (205, "ü Äß " * 3000)]


@pytest.mark.parametrize("train_rows", [8000, 30])
def test_scores_equal_a_plain_fit(spark, train_rows):
    rows = some_rows()
    docs = brute.documents(spark, rows).repartition(3)
    got = quality_model.quality_scores(docs, train_rows=train_rows).collect()
    votes = [plain_votes(t) for _, t in rows]
    post = plain_em(Counter(votes))
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    bound = min((1 << 63) - 1, int(min(1.0, train_rows / len(rows)) * (1 << 63)))
    drawn = {}
    for (_, t), v in zip(rows, votes):
        f, n = plain_features(t)
        if n and (hashes[t] % (1 << 64)) >> 1 <= bound:
            drawn[t] = (post[v], np.array(sorted(f), dtype=np.uint32), np.array([f[x] / (n + quality_model.SHRINK) for x in sorted(f)], dtype=np.float32))
    assert drawn and (train_rows == 8000 or len(drawn) < len({t for _, t in rows}) / 2)
    key = {r["text"]: (r["goal"], r["h"]) for r in spark.createDataFrame([(t, float(g), f.tobytes(), c.tobytes()) for t, (g, f, c) in drawn.items()], "text string, goal double, f binary, c binary").selectExpr("text", "goal", "xxhash64(f, c) as h").collect()}
    order = sorted(drawn, key=key.get)
    weights, bias = quality_model.train(np.array([drawn[t][0] for t in order]), [drawn[t][1] for t in order], [drawn[t][2] for t in order])
    want = []
    for (i, t), v in zip(rows, votes):
        f, n = plain_features(t)
        score = 1 / (1 + math.exp(-(sum(weights[x] * c for x, c in f.items()) / (n + quality_model.SHRINK) + bias))) if n else 0.0
        want.append((i, v, round(post[v], 5), round(score, 4)))
    assert Counter((r["doc_id"], r["votes"], round(r["posterior"], 5), round(r["score"], 4)) for r in got) == Counter(want)
    assert all(r["kept"] == (r["score"] >= 0.5) for r in got)


def test_a_share_far_below_a_millionth_still_teaches(spark):
    rows = [(k, f"the old mill by the river number {k} and some more words to read here") for k in range(200)] + [(1000 + k, "### $$$ " * 20 + str(k)) for k in range(100)]
    got = {r["doc_id"]: r["score"] for r in quality_model.quality_scores(brute.documents(spark, rows), train_rows=1e-9).collect()}
    assert len(set(got.values())) > 1 and all(x != 0.5 for x in got.values())
    assert np.mean([got[k] for k in range(200)]) > np.mean([got[1000 + k] for k in range(100)])
