"""Text quality as a linear model over n-gram indicators scaled by Naive Bayes.

A text's indicators are its words and the runs of one to three word shapes, hashed into a
fixed number of buckets. Each is scaled by the log ratio of its frequencies in the two
classes, vectors have unit length, and the weights minimise the hinge loss by dual
coordinate descent. Learning takes a bounded sample of labelled rows; scoring is one pass.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import mapped, text_function

BUCKETS = 1 << 18
#: Labelled rows to learn from at most, taken by hash of the id.
SAMPLE = 12_000
_REMEMBERED = 150_000
_RUNS = [(re.compile(p), r) for p, r in (
    (r"[a-zß-ÿ]+", "a"), (r"[A-ZÀ-Þ]+", "A"), (r"[0-9]+", "0"), (r"[^\x00-\xff]+", "x"),
    (r"(.)\1+", r"\1+"))]
_REPEAT = zlib.crc32(b"same word again")


class Features:
    """Buckets of a text's indicators. Remembers the words it has met."""

    def __init__(self):
        self._known: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        shape = word
        for run, mark in _RUNS:
            shape = run.sub(mark, shape)
        if len(self._known) > _REMEMBERED:
            self._known.clear()
        self._known[word] = found = zlib.crc32(b"word " + word.encode()), zlib.crc32(shape.encode())
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct buckets."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64)
        known, word = self._known.get, self._word
        pairs = np.array([known(w) or word(w) for w in words], np.uint64)
        shape = pairs[:, 1]
        same = np.array([a == b for a, b in zip(words, words[1:])], bool)
        shape[1:][same] = _REPEAT
        step = np.uint64(0x9E3779B97F4A7C15)
        grams, out = shape, [pairs[:, 0] * step, shape * step]
        for n in (1, 2):
            grams = grams[:-1] * np.uint64(0xBF58476D1CE4E5B9) + shape[n:] + np.uint64(n)
            out.append(grams * step)
        return np.unique(np.concatenate(out) >> np.uint64(64 - 18)).astype(np.int64)


class Rows:
    """Buckets of many texts as one flat array, four bytes each."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) // 4 for p in parts], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.flat = np.frombuffer(b"".join(parts), np.int32)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i]:self.starts[i + 1]]


def log_ratios(rows: Rows, labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of an indicator's share in class 1 to that in class 0, for every bucket."""
    share = []
    for label in (1, 0):
        n = np.full(BUCKETS, smooth)
        for i in np.nonzero(labels == label)[0]:
            # a row's buckets are distinct
            n[rows[i]] += 1
        share.append(np.log(n / n.sum()))
    return share[0] - share[1]


class Scaled:
    """Values of rows, their ratios brought to unit length, made when asked for."""

    def __init__(self, ratio: np.ndarray, rows: Rows):
        self.ratio, self.rows = ratio, rows

    def __getitem__(self, i: int) -> np.ndarray:
        return _scaled(self.ratio, self.rows[i])


def descend(rows, values, labels: np.ndarray,
            cost: float = 1.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the offset) of the L1-loss SVM by dual coordinate descent, of rows by number."""
    w = np.zeros(BUCKETS + 1)
    alpha = np.zeros(len(rows))
    y = np.where(labels == 1, 1.0, -1.0)
    order = np.random.default_rng(seed)
    # both classes weigh the same in the loss
    upper = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum()))
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            row, value = rows[i], values[i]
            slope = y[i] * (w[row] @ value + w[BUCKETS]) - 1.0
            # the vector has unit length, the offset adds one
            new = min(max(alpha[i] - slope / 2.0, 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(step))
                w[row] += step * value
                w[BUCKETS] += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _scaled(ratio: np.ndarray, row: np.ndarray) -> np.ndarray:
    x = ratio[row]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id does not."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 1, F.lit(False))


def sample_of(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
              sample: int = SAMPLE) -> DataFrame:
    """(id, label) of at most ``sample`` labelled rows that are not held out.

    Null ids and labels teach nothing; of contradicting labels the lower one counts.
    """
    return (labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label"))
            .where("id is not null and label in (0, 1)").where(~held_out(F.col("id")))
            .groupBy("id").agg(F.min("label").alias("label"))
            .orderBy(F.xxhash64("id"), "id").limit(sample))


class Model:
    """Ratios and weights; scores texts."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray):
        self.ratio, self.weights = ratio.astype(np.float32), weights.astype(np.float32)

    def score(self, row: np.ndarray) -> float:
        """From 0 to 1: the logistic function of twice the margin."""
        margin = float(self.weights[row] @ _scaled(self.ratio, row)) + float(self.weights[BUCKETS])
        return float(1.0 / (1.0 + np.exp(-2.0 * margin)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from the labelled texts of a bounded sample; only the sample meets the driver.

    The sample's ids are few by construction and are broadcast. Texts, never ids, languages
    or sources, become features. Without labelled texts every text scores one half.
    """
    chosen = sample_of(labels, id_col, label_col, sample)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(
        F.coalesce(docs[text_col], F.lit(""))).alias("t")).join(F.broadcast(chosen), "id")
    # where ids repeat, rows are bounded as ids are
    taken = rows.select("id", "t").distinct().orderBy(F.xxhash64("id", "t"), "id", "t").limit(sample)
    rows = rows.join(F.broadcast(taken), ["id", "t"]).dropDuplicates(["id", "t"])
    made: list[Features] = []

    def features(b: dict) -> dict:
        if not made:
            made.append(Features())
        return {"id": b["id"], "label": b["label"],
                "row": [made[0].of(t).astype(np.int32).tobytes() for t in b["text"]]}

    kind = docs.schema[id_col].dataType.simpleString()
    got = mapped(rows.select("id", "label", "text"), f"id {kind}, label int, row binary", features).collect()
    got.sort(key=lambda r: (r.id, bytes(r.row)))
    y, x = np.array([r.label for r in got], int), Rows([bytes(r.row) for r in got])
    del got
    if not len(y):
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS + 1))
    ratio = log_ratios(x, y)
    return Model(ratio, descend(x, Scaled(ratio, x), y))


def _score_of(spark, model: Model):
    """The score of a text as a function for tasks; the model (2 MB) goes out once."""
    sent = spark.sparkContext.broadcast((model.ratio, model.weights))
    made: list = []

    def score_of(text: str | None) -> float:
        if not made:
            made.extend((Features(), Model(*sent.value)))
        return made[1].score(made[0].of(text))

    return score_of


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row. Texts without words, and null ones, score by the offset alone."""
    score_of = _score_of(docs.sparkSession, model)

    def run(b: dict) -> dict:
        return {"id": b["id"], "score": [score_of(t) for t in b["text"]]}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return mapped(rows, f"id {kind}, score double", run).withColumnRenamed("id", id_col)


def scorer(spark, model: Model):
    """The score as a function of a text column, for filters that keep all columns."""
    return text_function(_score_of(spark, model), "double")
