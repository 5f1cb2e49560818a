"""Token alignment against whole encodings, with awkward texts."""

import random
import sys
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from mnemoframe.llm import token_spans  # noqa: E402

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def sides():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    paths = public_tokenizers.path(token_spans.LEFT), public_tokenizers.path(token_spans.RIGHT)
    left = Tokenizer.from_file(paths[0])
    left.encode_special_tokens = True
    return paths, left, sentencepiece.SentencePieceProcessor(model_file=paths[1])


def odd_texts(n=150, seed=3):
    draw = random.Random(seed)
    signs = "aé丂\U0001F600 \n\t'  \x1c<s>|x9 ."
    texts = ["".join(draw.choices(signs, k=draw.randint(1, 60))) for _ in range(n)]
    return texts + ["mark ▁ here", " ", "  a  b ", "x" * 3000 + " é" * 50, "<|endoftext|> </s> <unk>", "\x00a \x00 b", "\r\n \r\n", "é 丂丂七" * 30, "same words again", "same words again"]


def test_summary_equals_whole_encodings(spark, sides):
    paths, left, right = sides
    given = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pydict()["text"][:40]
    rows = list(enumerate(odd_texts() + [t[:1500] for t in given])) + [(7, "repeated id"), (None, "no id"), (5000, None), (5001, "")]
    got = token_spans.alignment_summary(brute.documents(spark, rows).repartition(3), *paths).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(brute.alignment_rows(rows, left, right))


def test_groups_join_to_the_text(spark, sides):
    paths, left, right = sides
    rows = list(enumerate(odd_texts(60, 5))) + [(900, None)]
    for r in token_spans.aligned_groups(brute.documents(spark, rows), *paths).collect():
        text = dict(rows)[r["doc_id"]]
        want = brute.alignment(text, left, right)
        assert [(g["left_ids"], g["right_ids"]) for g in r["groups"]] == (want[2] if want else [])
        if want:
            ends = [0, *[g["end"] for g in r["groups"]]]
            assert [g["start"] for g in r["groups"]] == ends[:-1] and ends[-1] == len((" " + text).encode())


def test_units_are_forgotten_and_learned_again(sides, monkeypatch):
    paths, left, right = sides
    texts = odd_texts(80, 9)
    want = [brute.alignment(t, left, right) for t in texts]
    monkeypatch.setattr(token_spans, "CACHED_UNITS", 20)
    monkeypatch.setattr(token_spans, "LEARN_CHARS", 100)
    monkeypatch.setattr(token_spans, "BATCH_CHARS", 30)
    aligner = token_spans.Aligner(*paths)
    for w, found in zip(want, aligner.documents(texts), strict=True):
        assert (found is None) == (w is None)
        if w:
            assert (sum(u[0] for u in found), sum(u[1] for u in found), sum(u[2] for u in found)) == (len(w[0]), len(w[1]), len(w[2]))


def test_empty_table(spark, sides):
    assert token_spans.alignment_summary(brute.documents(spark, [(1, "a")]).limit(0), *sides[0]).collect() == []


def test_spans_are_asked_for_only_where_bytes_differ(sides, monkeypatch):
    aligner = token_spans.Aligner(*sides[0])
    asked, spans = [], token_spans.Aligned._by_spans
    monkeypatch.setattr(token_spans.Aligned, "_by_spans", lambda self, *a: asked.append(1) or spans(self, *a))
    plain = ["plain", "text,", "é🜁", "乌龙茶"]
    by_bytes = aligner.aligned(plain).units()
    assert not asked and None not in by_bytes
    # one odd unit asks for spans and leaves the others as they are
    mixed = aligner.aligned([*plain[:2], "a▁b", *plain[2:]]).units()
    assert asked and mixed[2] is None and [*mixed[:2], *mixed[3:]] == by_bytes
