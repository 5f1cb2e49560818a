"""Language proportions of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import spans

#: Bytes in an n-gram, and the logarithm of the number of hashed n-grams.
SIZE = 3
LOG_GRAMS = 15
GRAMS = 1 << LOG_GRAMS
#: Groups in which the counts of one language are added up first.
SALT = 16
ROUNDS = 12
#: Each further language must gain so many times log(n-grams) of likelihood.
PENALTY = 4.0
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the bytes of each text, and where each text's begin. ASCII letters are folded, other ASCII bytes count as a space."""
    data, offsets = spans.buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    folded = _FOLD[data]
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    cuts = offsets[:-1][offsets[:-1] < len(folded)]
    keep[cuts] = True
    begin = np.concatenate([[0], np.cumsum(keep)])[offsets]
    folded = folded[keep]
    code = np.zeros(max(0, len(folded) - SIZE + 1), dtype=np.uint32)
    for k in range(SIZE):
        code = code << np.uint32(8) | folded[k:len(folded) - SIZE + 1 + k]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - LOG_GRAMS)
    counts = np.maximum(np.diff(begin) - SIZE + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    where = np.repeat(begin[:-1] - at[:-1], counts) + np.arange(at[-1])
    return code[where].astype(np.int64), at


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of each language in this task: (lang, salt, counts)."""
    total: dict[str, np.ndarray] = {}
    for b in spans.slices(batches, "t"):
        found, begin = grams(b.column("t"))
        langs = b.column("lang").to_pylist()
        names = sorted(set(langs))
        of = np.repeat(np.array([names.index(x) for x in langs]), np.diff(begin))
        for k, name in enumerate(names):
            total.setdefault(name, np.zeros(GRAMS, dtype=np.int64))
            total[name] += np.bincount(found[of == k], minlength=GRAMS)
    yield _packed(total, TaskContext.get().partitionId() % SALT)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts added up by language; holds one row of counts for each language that this task reads."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for name, packed in zip(b.column("lang").to_pylist(), b.column("counts").to_pylist()):
            total.setdefault(name, np.zeros(GRAMS, dtype=np.int64))
            total[name] += np.frombuffer(packed, dtype="<i8")
    yield _packed(total, 0)


def _packed(total: dict[str, np.ndarray], salt: int) -> pa.RecordBatch:
    return pa.record_batch({"lang": pa.array(list(total), pa.string()), "salt": pa.array([salt] * len(total), pa.int32()), "counts": pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())})


class Model:
    """Likelihoods of n-grams by language, from counts."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        table = np.array([counts[x] for x in self.names], dtype=np.float64).reshape(len(self.names), GRAMS)
        # a fixed part of each language's n-grams is taken as spread over all
        self.chance = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * GRAMS)


def _fit(chance: np.ndarray, counts: np.ndarray, of: np.ndarray, begin: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, texts) shares by EM over the allowed languages of each text, and each text's log likelihood.

    chance and counts have an entry for each text's distinct n-grams, `of` their texts, `begin` the first of each text.
    """
    share = allowed / allowed.sum(axis=0)
    total = np.add.reduceat(counts, begin)
    for _ in range(ROUNDS):
        part = np.take(share, of, axis=1)
        part *= chance
        part *= counts / part.sum(axis=0)
        share = np.add.reduceat(part, begin, axis=1) / total
    mixed = (np.take(share, of, axis=1) * chance).sum(axis=0)
    return share, np.add.reduceat(counts * np.log(mixed), begin)


def mixtures(model: Model, texts: pa.Array, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, languages) proportions, zero outside the chosen set; which texts have a letter; the number of their n-grams.

    The single best language is the start. Languages join in the order of their shares under all languages, as long as the
    likelihood less PENALTY * languages * log(n-grams) grows.
    """
    found, begin = grams(texts)
    letters = pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False)
    n, langs = len(texts), len(model.names)
    shares = np.zeros((n, langs))
    size = np.diff(begin)
    rows = np.flatnonzero(size > 0)
    if langs == 0 or not len(rows):
        return shares, letters, size
    # distinct n-grams of each text with their counts
    key, counts = np.unique(np.repeat(np.arange(n), size) * GRAMS + found, return_counts=True)
    text = np.searchsorted(rows, key // GRAMS)
    chance = model.chance[:, key % GRAMS]
    counts = counts.astype(np.float64)
    first = np.searchsorted(text, np.arange(len(rows)))
    alone = np.add.reduceat(counts * np.log(chance), first, axis=1)
    best = alone.max(axis=0)
    chosen = np.zeros((langs, len(rows)))
    chosen[alone.argmax(axis=0), np.arange(len(rows))] = 1.0
    penalty = PENALTY * np.log(size[rows] + 1.0)
    if langs > 1:
        share, likelihood = _fit(chance, counts, text, first, np.ones((langs, len(rows))))
        order = np.argsort(-share, axis=0, kind="stable")
        # no set of languages is more likely than all of them, but for what EM has left to gain
        going = likelihood + 1 - penalty > best
        for k in range(2, (langs if most is None else min(most, langs)) + 1):
            live = np.flatnonzero(going)
            if not len(live):
                break
            allowed = np.zeros((langs, len(rows)))
            np.put_along_axis(allowed, order[:k], 1.0, axis=0)
            inside = going[text]
            own = np.searchsorted(live, text[inside])
            share, likelihood = _fit(chance[:, inside], counts[inside], own, np.searchsorted(own, np.arange(len(live))), allowed[:, live])
            better = likelihood - penalty[live] > best[live]
            best[live[better]] = (likelihood - penalty[live])[better]
            chosen[:, live[better]] = share[:, better]
            going[live[~better]] = False
    shares[rows] = chosen.T
    return shares, letters, size


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all documents for which `learn` holds and that have a text and a language."""
    rows = docs.where(learn).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")).where("t is not null and lang is not null")
    schema = "lang string, salt int, counts binary"
    added = rows.mapInArrow(_counts, schema).repartition("lang", "salt").mapInArrow(_added, schema).repartition("lang").mapInArrow(_added, schema)
    # one row for each language
    return Model({x["lang"]: np.frombuffer(bytes(x["counts"]), dtype="<i8") for x in added.collect()})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score (its share of the text), languages, shares (the chosen set, largest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.names, dtype=object)
        for b in spans.slices(batches, "t", 2 << 20):
            shares, letters, size = mixtures(model, b.column("t"), most)
            pred, score, sets, parts = [], [], [], []
            for k in range(b.num_rows):
                some = np.flatnonzero(shares[k])
                some = some[np.lexsort((some, -shares[k][some]))]
                if not letters[k] or not len(some):
                    known = letters[k] and len(names)
                    pred.append(names[0] if known else UNKNOWN)
                    score.append(1.0 / len(names) if known else 0.0)
                    sets.append([])
                    parts.append([])
                    continue
                pred.append(names[some[0]])
                score.append(min(1.0, float(shares[k][some[0]])))
                sets.append(names[some].tolist())
                parts.append(shares[k][some].tolist())
            yield pa.record_batch({"id": b.column("id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "languages": pa.array(sets, pa.list_(pa.string())), "shares": pa.array(parts, pa.list_(pa.float64()))})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, languages array<string>, shares array<double>").withColumnRenamed("id", "doc_id")


def language_mixture(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int | None = None) -> DataFrame:
    """Languages of each row of docs, by a model of those rows for which `learn` holds: doc_id, lang_pred, score, languages, shares.

    Byte trigrams of the lower-cased whole text, hashed into 2^15 places, are counted for each language over all documents that
    learn. In each document EM finds the shares of the languages; as many as penalised likelihood
    takes are chosen, up to `most` if it is given.
    lang_pred is the one with the largest share (ties: the first by name), score its share.

    Null and empty texts and those without a letter are `und` with score 0 and no languages; a text of letters too short for a
    trigram gets the first language with an even share. Null languages teach nothing; without any lesson all texts are `und`. Null
    doc_ids and repeated rows are rows like others, columns other than the named ones are not looked at, an empty table gives no
    rows.
    """
    return predict(docs, train(docs, learn, id_col, text_col, lang_col), id_col, text_col, most)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    found = language_mixture(docs, fold != 1)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
