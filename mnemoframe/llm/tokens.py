"""Token ids of documents, cut to pieces of bounded length."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemoframe.llm import spans

#: fixed values: the pre-tokenizer pattern of a vocabulary that drops white space, so that words are encoded alone
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters that Unicode composition leaves as they are and that have one lower-case letter each
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ž"
#: words that need no whole tokenizer; its special tokens hold a <
_PLAIN = re.compile(f"[!-;=-~{_LETTERS}]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
#: Words, and parts of words, whose ids a worker keeps at once.
CACHED_WORDS = 300_000
CACHED_PARTS = 200_000
END = 1


@cache
def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: a printable byte stands for itself, the others for the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _bytes(ids: list[int]) -> bytes:
    """Little-endian 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Words(dict):
    """Little-endian 32-bit ids of a word; filled on demand, emptied when full."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.encode(word)
        return found


class Encoder:
    """Ids of texts as one vocabulary file gives them.

    If the file's rules drop white space and look at nothing across it, each word is encoded once and kept; plain Latin words
    go to the vocabulary's model directly, all others through the whole tokenizer. With other rules each text goes there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        rules = json.loads(Path(path).read_text())
        self.by_word = _drops_space(rules) and all("<" in x["content"] for x in rules.get("added_tokens", []))
        self.model = self.whole.model
        self.parts = _Words(self._part, CACHED_PARTS)
        self.words = _Words(self._word, CACHED_WORDS)
        self.size = self.whole.get_vocab_size()

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            letters = byte_letters()
            part = "".join(letters[b] for b in part.encode())
        return _bytes([x.id for x in self.model.tokenize(part)])

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))
        return _bytes(self.whole.encode(word, add_special_tokens=False).ids)

    def packed(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text; none for null."""
        if not text:
            return b""
        if not self.by_word:
            return _bytes(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process, with the words that it has met."""
    return Encoder(path)


def _drops_space(rules: dict) -> bool:
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    names = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
    split = steps[0] if steps else {}
    return (names == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("pattern", {}).get("Regex") == WORD_PATTERN
            and split.get("behavior") == "Removed" and split.get("invert") is True and not (rules.get("model") or {}).get("dropout")
            and [x["type"] for x in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in rules.get("added_tokens", [])))


def pieces(rows: DataFrame, vocabulary: str, capacity: int, with_ids: bool = False, end: int = END) -> DataFrame:
    """Pieces of rows (id, t): id, piece, start, length, crc; with_ids: the ids, 16 or 32 bits each, deflated.

    A document is its ids and then `end`, so null and empty texts have one id. Only documents longer than `capacity` are cut, into
    full pieces and a last one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        narrow = max(encoder.size, end + 1) <= 1 << 16
        tail = np.array([end], dtype="<u4").tobytes()
        for b in spans.slices(batches, "t"):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(b.column("t").to_pylist()):
                whole = encoder.packed(text) + tail
                for n, lo in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[lo:lo + 4 * capacity]
                    row.append(k)
                    piece.append(n)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(zlib.compress(np.frombuffer(part, dtype="<u4").astype("<u2").tobytes() if narrow else part, 1))
            out = {"id": b.column("id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                   "length": pa.array(length, pa.int64()), "crc": pa.array(crc, pa.int64())}
            yield pa.record_batch(out | ({"ids": pa.array(ids, pa.binary()), "narrow": pa.array([narrow] * len(ids))} if with_ids else {}))

    return rows.mapInArrow(run, "id long, piece int, start long, length long, crc long" + ", ids binary, narrow boolean" * with_ids)


def unpacked(ids: bytes, narrow: bool) -> np.ndarray:
    """Ids of a piece as 32-bit numbers."""
    return np.frombuffer(zlib.decompress(ids), dtype="<u2" if narrow else "<u4").astype("<u4")
