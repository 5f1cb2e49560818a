"""Conversation repair against a plain search, with small blocks and with SQL."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from functools import cache
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from mnemoframe.llm import conversation_repair as repair  # noqa: E402

SIGNS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """Cost, audit and repaired lines of one conversation's (turn, role, text), by all ways of editing from the end."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SIGNS)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))

    @cache
    def rest(i, s, inserted):
        """Least (cost, audit, lines) from row i on; at most two inserts at one place can help."""
        ways = []
        if i == len(rows) and s in "0a":
            ways.append((0, "", ()))
        new = "assistant" if s == "u" else "user"
        if inserted < 2 and (x := rest(i, new[0], inserted + 1)):
            ways.append((x[0] + 5, "I" + x[1], (new + ":", *x[2])))
        if i < len(rows):
            _, role, text = rows[i]
            x = rest(i + 1, s, 0)
            ways.append((x[0] + 2, "D" + x[1], x[2]))
            if faults[i] not in (1, 2):
                more = 5 if faults[i] == 3 else 0
                x = rest(i + 1, new[0], 0)
                ways.append((x[0] + 1 + more, "R" + x[1], (f"{new}:{text}", *x[2])))
                if s + role[:1] in ("0s", "0u", "su", "ua", "au"):
                    x = rest(i + 1, role[0], 0)
                    ways.append((x[0] + more, "K" + x[1], (f"{role}:{text}", *x[2])))
        return min(ways, default=None) and min(ways, key=lambda w: w[:2])

    cost, audit, lines = rest(0, "0", 0)
    firsts = [r[1][:1] for r in rows]
    turns = {r[0] for r in rows if r[0] is not None}
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(k) for k in (1, 2, 3)], sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def report(names, rows):
    groups = {}
    for conv, *row in rows:
        groups.setdefault(conv, []).append(tuple(row))
    return Counter((conv, *(plain(groups[conv]) if conv in groups else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))) for conv in set(names))


def conversations(n=120, seed=1):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "User", "", " u", None, "sys", "a"]
    texts = ["Yes.", "No!", "Why?", "cut of", "", " \n", "Long. \t", "x" * 50 + ".", None, "ja", "Ω."]
    out = []
    for conv in range(n):
        for turn in range(draw.choice((0, 1, 2, 3, 5, 8, 13))):
            role = ("user", "assistant")[turn % 2] if draw.random() < 0.6 else draw.choice(roles)
            out.append((conv, draw.choice((turn, turn, turn, None, turn + 3)), role, draw.choice(texts)))
    return out


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *[F.lit("other").alias(c) for c in brute.CLASHING if c not in ("t",)]).repartition(5)


def test_report_equals_plain_search(spark):
    rows = conversations() + [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (500, 1, "user", "Y" * 70_000 + "."), (501, None, None, None)]
    df = frame(spark, rows)
    got = repair.repair_report(df, repair.damaged(df)).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == report([r[0] for r in rows], damage(rows))


@pytest.mark.parametrize("block, fan", [(1, 2), (3, 2), (4, 4)])
def test_long_conversations_in_blocks(spark, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = [(c % 3, t, r, x) for c, t, r, x in conversations(60, 7)] + conversations(20, 9)
    df = frame(spark, rows).where("role is not null or turn is not null")
    rows = [tuple(r[:4]) for r in df.collect()]
    got = repair.repair_report(df, repair.damaged(df)).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == report([r[0] for r in rows], damage(rows))


def test_repaired_rows_follow_the_grammar(spark):
    rows = conversations(40, 3)
    repaired = repair.repair(repair.damaged(frame(spark, rows)))
    out = repair.repaired_rows(repaired).orderBy("key", "node", "place", "step").collect()
    roles = {}
    for r in out:
        roles[r["key"]] = roles.get(r["key"], "") + r["role"][0]
    assert roles and all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())


def test_ties_and_repeats():
    assert repair.lightest("u0a0", 0) == (0, "KK")
    # one user row alone: deleting costs 2, an answer 5
    assert repair.lightest("u0", 0) == (2, "D")
    # equal costs: K before R before D, and I after D
    assert repair.lightest("u0u0", 0) == (1, "KR")
    assert repair.lightest("-0-0", 0) == (2, "RR")
    assert repair.lightest("", 0) == (0, "")
    assert repair.lightest("u2u1", 0) == (4, "DD")


def test_empty_table(spark):
    df = frame(spark, [(1, 1, "user", "a")]).limit(0)
    assert repair.repair_report(df, repair.damaged(df)).collect() == []


def test_sql_gives_the_same_rows(spark):
    from compare import difference, duck

    assert difference(repair.op11_conversation_repair(spark, "/root/testdata/sf0.001"), duck("/root/testdata/sf0.001"), repair.OP11_SQL) == ""
