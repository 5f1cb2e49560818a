"""Weak-label quality classifier: expectation-maximisation over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import spans
from mnemoframe.llm.tables import documents

#: Documents that train the linear scorer, about: all of a smaller table, else those whose hash is small enough.
TRAIN_ROWS = 8_000
LOG_FEATURES = 18
EPOCHS = 6
THRESHOLD = 0.5
#: Words of no weight that every text gets, so that a few words alone say little.
SHRINK = 20

BAD, GOOD, SILENT = 0, 1, 2
#: Each labeller: a share of a text, from where on it says bad, up to where it says good; in between it is silent.
LABELLERS = (
    ("symbols", 0.05, 0.01),
    ("capitals", 0.5, 0.2),
    ("marked_words", 0.3, 0.05),
    ("bare_marks", 0.15, 0.03),
    ("repeated_runs", 0.4, 0.15),
    ("repeated_lines", 0.5, 0.2),
    ("same_as_before", 0.2, 0.06),
)
#: Texts with fewer words say too little: the labellers on words are silent.
MIN_WORDS = 10

_SYMBOLS = spans.byte_set(b"#*$%&|<>")
_UPPER = spans.byte_set(bytes(range(65, 91)))
_LETTER = spans.byte_set(bytes(range(65, 91)) + bytes(range(97, 123)))
_WORDY = spans.byte_set(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_LOUD = spans.byte_set(b"#*$%&|<>!~^=_")


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive places."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[begin[1:]] - total[begin[:-1]]


def _repeats(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each text the number of values that occurred earlier in it."""
    sorted_ = values.copy()
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist()):
        sorted_[lo:hi].sort()
    same = np.zeros(len(values), dtype=np.int64)
    same[1:] = sorted_[1:] == sorted_[:-1]
    same[begin[:-1][begin[:-1] < len(values)]] = 0
    return _sums(same, begin)


class Texts:
    """Words and shares of a column of texts."""

    def __init__(self, texts: pa.Array):
        data, offsets = spans.buffers(texts)
        self.data = data
        self.starts, self.ends, self.first = spans.word_spans(data, offsets)
        self.hashes = spans.hashes(data, self.starts, self.ends)
        self.n = np.diff(self.first)
        lines = spans.line_spans(data, offsets)
        lo, hi = spans.stripped(data, *lines[:2])
        some = hi > lo
        self.line_first = np.concatenate([[0], np.cumsum(some)])[lines[2]]
        self.lines = spans.hashes(data, lo[some], hi[some])
        self.bytes = lambda table: _sums(table[data], offsets)
        self.offsets = offsets

    def votes(self) -> np.ndarray:
        """(texts, labellers) of BAD, GOOD or SILENT."""
        words = np.maximum(self.n, 1)
        runs, begin = spans.shingle_hashes(self.hashes, self.first, 3)
        last = self.data[self.ends - 1] if len(self.ends) else self.data[:0]
        wordy = np.concatenate([[0], np.cumsum(_WORDY[self.data])])
        bare = wordy[self.ends] == wordy[self.starts]
        before = np.zeros(len(self.hashes), dtype=np.int64)
        before[1:] = self.hashes[1:] == self.hashes[:-1]
        before[self.first[:-1][self.first[:-1] < len(before)]] = 0
        letters, few = self.bytes(_LETTER), self.n < MIN_WORDS
        n_lines = np.diff(self.line_first)
        shares = {
            "symbols": (self.bytes(_SYMBOLS) / np.maximum(np.diff(self.offsets), 1), self.n == 0),
            "capitals": (self.bytes(_UPPER) / np.maximum(letters, 1), letters < 3 * MIN_WORDS),
            "marked_words": (_sums(_LOUD[last] & ~bare, self.first) / words, few),
            "bare_marks": (_sums(bare, self.first) / words, few),
            "repeated_runs": (_repeats(runs, begin) / np.maximum(np.diff(begin), 1), few),
            "repeated_lines": (_repeats(self.lines, self.line_first) / np.maximum(n_lines, 1), n_lines < 4),
            "same_as_before": (_sums(before, self.first) / words, few),
        }
        out = np.full((len(self.n), len(LABELLERS)), SILENT, dtype=np.uint8)
        for k, (name, bad, good) in enumerate(LABELLERS):
            share, silent = shares[name]
            out[:, k] = np.where(silent, SILENT, np.where(share >= bad, BAD, np.where(share <= good, GOOD, SILENT)))
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashed features for each word: the word, and its ends with its length and the kind of the word before."""
        mask = np.uint64((1 << LOG_FEATURES) - 1)
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        head, last = self.data[self.starts].astype(np.uint64), self.data[self.ends - 1].astype(np.uint64)
        length = np.minimum(self.ends - self.starts, 15).astype(np.uint64)
        same = np.zeros(len(self.hashes), dtype=np.uint64)
        same[1:] = self.hashes[1:] == self.hashes[:-1]
        kind = np.where(_UPPER[self.data[self.starts]], 1, np.where(_WORDY[self.data[self.starts]], 0, head)).astype(np.uint64)
        second = self.data[np.minimum(self.starts + 1, self.ends - 1)]
        shape = (((kind << np.uint64(8) | np.where(_WORDY[last.astype(np.int64)], 0, last).astype(np.uint64)) << np.uint64(4) | length) << np.uint64(2) | same << np.uint64(1) | _UPPER[second].astype(np.uint64))
        return (self.hashes & mask).astype(np.int64), (spans.mix(shape, 9) & mask).astype(np.int64)


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in spans.slices(batches, "t"):
        yield pa.record_batch({"id": b.column("id"), "votes": pa.array([x.tobytes().translate(_DIGITS).decode() for x in Texts(b.column("t")).votes()], pa.string())})


_DIGITS = bytes(48 + k if k < 3 else 63 for k in range(256))


def expectation_maximisation(patterns: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of good for each pattern of votes, and (labellers, 2, 2) the chances of a bad and a good vote for bad and good texts.

    Votes are taken as independent given the class, and silence says nothing. The start is one doubt for each bad vote; a
    labeller's accuracy comes from the posteriors of all texts on which it votes, with one added count.
    """
    if not patterns:
        return {}, np.zeros((len(LABELLERS), 2, 2))
    votes = np.array([[int(c) for c in p] for p in patterns])
    weight = np.array(list(patterns.values()), dtype=np.float64)
    bad, good = (votes == BAD).sum(axis=1), (votes == GOOD).sum(axis=1)
    # a text is as good as its worst sign: few labellers speak up for the same fault
    post = np.where(bad > 0, 0.2 ** bad, np.where(good > 0, 0.95, 0.5))
    chance = np.zeros((votes.shape[1], 2, 2))
    for _ in range(rounds):
        for k in range(votes.shape[1]):
            for c, w in enumerate((weight * (1 - post), weight * post)):
                count = np.bincount(votes[:, k], weights=w, minlength=3)[:2] + 1
                chance[k, c] = count / count.sum()
        prior = (weight @ post + 1) / (weight.sum() + 2)
        said = np.concatenate([np.log(chance), np.zeros((votes.shape[1], 2, 1))], axis=2)
        log = np.stack([said[:, c, :][np.arange(votes.shape[1]), votes].sum(axis=1) for c in (0, 1)])
        odds = log[1] - log[0] + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return dict(zip(patterns, post.tolist())), chance


def _examples(posterior: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Posterior, features and their counts of each text."""
        for b in spans.slices(batches, "t"):
            texts = Texts(b.column("t"))
            goal = [posterior.get(x.tobytes().translate(_DIGITS).decode(), 0.5) for x in texts.votes()]
            one, two = texts.features()
            ids, counts = [], []
            for lo, hi in zip(texts.first[:-1].tolist(), texts.first[1:].tolist()):
                f, n = np.unique(np.concatenate([one[lo:hi], two[lo:hi]]), return_counts=True)
                ids.append(f.astype(np.uint32).tobytes())
                counts.append((n / (hi - lo + SHRINK)).astype(np.float32).tobytes())
            out = pa.record_batch({"id": b.column("id"), "goal": pa.array(goal, pa.float64()), "features": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary())})
            yield out.filter(pa.array(texts.n > 0))
    return run


def train(goals: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by adaptive gradient steps, in a fixed order; features and their counts for each text."""
    weights, seen = np.zeros(1 << LOG_FEATURES), np.full(1 << LOG_FEATURES, 1e-6)
    bias = 0.0
    order = np.random.default_rng(7)
    total = 1e-6
    for _ in range(EPOCHS):
        for k in order.permutation(len(goals)):
            f, x = ids[k].astype(np.int64), counts[k].astype(np.float64)
            step = 1 / (1 + np.exp(-np.clip(weights[f] @ x + bias, -50, 50))) - goals[k]
            grad = step * x + 1e-6 * weights[f]
            seen[f] += grad ** 2
            weights[f] -= 0.3 * grad / np.sqrt(seen[f])
            total += step ** 2
            bias -= 0.3 * step / np.sqrt(total)
    return weights, bias


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the weights that are not zero, from the examples of the single task that this runs in, about TRAIN_ROWS."""
    goals, ids, counts = [], [], []
    for b in batches:
        goals += b.column("goal").to_pylist()
        ids += [np.frombuffer(x, dtype=np.uint32) for x in b.column("features").to_pylist()]
        counts += [np.frombuffer(x, dtype=np.float32) for x in b.column("counts").to_pylist()]
    weights, bias = train(np.array(goals), ids, counts)
    at = np.flatnonzero(weights)
    yield pa.record_batch({"n": pa.array([len(goals)], pa.int64()), "bias": pa.array([bias], pa.float64()), "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "weights": pa.array([weights[at].tobytes()], pa.binary())})


def scores(model: tuple[np.ndarray, float], texts: Texts) -> np.ndarray:
    """Chance that each text is good; 0 for a text without words."""
    weights, bias = model
    one, two = texts.features()
    score = 1 / (1 + np.exp(-np.clip(_sums(weights[one] + weights[two], texts.first) / (texts.n + SHRINK) + bias, -50, 50)))
    score[texts.n == 0] = 0
    return np.round(score, 9)


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, "t"):
            texts = Texts(b.column("t"))
            votes = [x.tobytes().translate(_DIGITS).decode() for x in texts.votes()]
            yield pa.record_batch({"id": b.column("id"), "votes": pa.array(votes, pa.string()), "score": pa.array(scores(model.value, texts))})
    return run


def fit(rows: DataFrame, train_rows: int) -> tuple[dict[str, float], Broadcast]:
    """Posteriors of the vote patterns of rows (id, t, h), and the scorer that learned them."""
    patterns = {x["votes"]: x["count"] for x in rows.select("id", "t").mapInArrow(_vote_rows, "id long, votes string").groupBy("votes").count().orderBy("votes").collect()}
    posterior, _ = expectation_maximisation(patterns)
    total = sum(patterns.values())
    share = min(1.0, train_rows / max(1, total))
    while True:
        # a text's hash without its sign is below a bound of 63 bits, so that any share is more than nothing
        drawn = rows.where(F.expr("shiftrightunsigned(h, 1)") <= F.lit(min((1 << 63) - 1, int(share * (1 << 63))))).select("id", "t")
        examples = drawn.mapInArrow(_examples(posterior), "id long, goal double, features binary, counts binary")
        # equal texts teach once; one task fits them, in a fixed order, and only the weights reach the driver
        examples = examples.select("goal", "features", "counts").distinct().repartition(1).sortWithinPartitions("goal", F.xxhash64("features", "counts"), "features", "counts")
        found = examples.mapInArrow(_trained, "n long, bias double, at binary, weights binary").first()
        if found is not None and found["n"] or share >= 1.0:
            break
        # no text with words was drawn
        share = min(1.0, 64 * share)
    weights = np.zeros(1 << LOG_FEATURES)
    if found is not None:
        weights[np.frombuffer(found["at"], dtype=np.int32)] = np.frombuffer(found["weights"])
    return posterior, rows.sparkSession.sparkContext.broadcast((weights, found["bias"] if found is not None else 0.0))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, votes, posterior, score, kept.

    Seven heuristics vote good, bad or nothing on each text. Expectation-maximisation over the counts of all vote patterns (at
    most 3^7, whatever the size of the table) estimates each labeller's accuracy and each pattern's posterior. Posteriors
    are the labels of a logistic scorer on 2^18 hashed features (words, and their shapes), fitted on about train_rows documents
    drawn by hash (more, where these hold no word); its score in every document, from the whole text, decides: kept if score >= threshold.

    Null and empty texts and those without words have score 0 and are rejected; null doc_ids and repeated rows get rows of their own
    like others. Without any text with words nothing is learned and every score is 0. Columns other than the two named ones are
    not looked at. An empty table gives no rows.
    """
    rows = documents(docs, id_col, text_col).withColumn("h", F.xxhash64("t"))
    posterior, model = fit(rows, train_rows)
    scored = rows.select("id", "t").mapInArrow(_score_rows(model), "id long, votes string, score double")
    known = F.create_map(*[F.lit(x) for p in posterior.items() for x in p]) if posterior else F.expr("cast(null as map<string, double>)")
    return scored.select(F.col("id").alias("doc_id"), "votes", F.round(known[F.col("votes")], 9).alias("posterior"), "score", (F.col("score") >= threshold).alias("kept"))


def well_written(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns; rows with null or empty text go. No row is shuffled."""
    model = fit(documents(docs, id_col, text_col).withColumn("h", F.xxhash64("t")), train_rows)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in spans.slices(batches, text_col):
            yield b.filter(pa.array(scores(model.value, Texts(b.column(text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
