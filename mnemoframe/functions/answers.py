"""Parsers of model answers: NULL instead of an exception."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import trimmed


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _single(c: str | Column, pattern: str) -> Column:
    token = F.upper(trimmed(c))
    return F.when(token.rlike(f"\\A(?:{pattern})\\z"), token)


def option_letter(c: str | Column) -> Column:
    """One letter A to Z."""
    return _single(c, "[A-Z]")


def trajectory_option(c: str | Column) -> Column:
    """A, B, C or D."""
    return _single(c, "[ABCD]")


def behavior_score(c: str | Column) -> Column:
    """0, 1 or 2."""
    return _single(c, "[012]").cast("int")


def pairwise_token(c: str | Column) -> Column:
    """A, B or TIE."""
    return _single(c, "A|B|TIE")


# Headers before a judge's score and the form of the score.
SCORE_HEADERS = ("### **Evaluation Score**", "### Evaluation Score")
SCORE_FORM = r"\A\*{0,2}(10|[1-9])(?:\.0+)?(?:\s*/\s*10)?\*{0,2}(?:\s*[-–—:]\s+\S.*)?\z"


def judge_score(c: str | Column) -> Column:
    """Score 1 to 10 from the first line after exactly one score header."""
    text = _col(c)
    count = lambda h: F.size(F.split(text, r"\Q" + h + r"\E", -1)) - 1
    counts = [count(h) for h in SCORE_HEADERS]
    total = counts[0] + counts[1]
    after = lambda h: F.element_at(F.split(text, r"\Q" + h + r"\E", 2), -1)
    tail = F.when(counts[0] == 1, after(SCORE_HEADERS[0])).otherwise(after(SCORE_HEADERS[1]))
    line = trimmed(F.get(F.split(trimmed(tail), r"\r\n|\r|\n", -1), F.lit(0)))
    score = F.regexp_extract(line, SCORE_FORM, 1)
    return F.when((total == 1) & (score != ""), score.cast("int"))


def pair_consensus(forward: str | Column, reverse: str | Column) -> Column:
    """Winner of two judgements in swapped order: left, right, tie, or inconsistent; NULL if unreadable."""
    f, r = pairwise_token(forward), pairwise_token(reverse)
    first = F.when(f == "A", "left").when(f == "B", "right").when(f == "TIE", "tie")
    second = F.when(r == "A", "right").when(r == "B", "left").when(r == "TIE", "tie")
    return F.when(first.isNull() | second.isNull(), None).when(first == second, first).otherwise("inconsistent")
