"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features serves all grades; ordered thresholds cut the score into them:
P(grade > k) = sigmoid(score - threshold_k). A document gets its expected grade and the tail probabilities
that selection uses. The model is fitted on a bounded sample of rated documents; features are made in
tasks, and every document's whole text is scored where it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, chunks, sample, table, utf8
from .words import NOT_ALPHANUMERIC, SPACES, mix, words_of

#: Width of the hashed word features; rated documents that are learned from (smallest hashes), whole texts.
BITS, SAMPLE_DOCS = 18, 10000
STEPS, RATE, RIDGE = 200, 0.05, 1e-3
#: Rated documents that must hold a word before it gets a weight.
LEAST_DOCS = 10
SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]\\^~_=+@/", np.uint8)
SHAPES = 16
#: Tail probability of the top grade from which a document is kept: of tenths the highest that loses under 2 in 100 good rated documents, by cross-validation.
KEEP = 0.6
#: Bytes of a longer word's beginning that count as a feature too.
PREFIXES = (5, 7)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, feature, value): sparse rows one after another; row i is first[i]:first[i+1].

    Different lower-case words of a text, and their beginnings, count once each; then shares of symbols, lines and repeated words,
    word length and text length in steps.
    """
    words = words_of(texts, NOT_ALPHANUMERIC, fold=True)
    hashes, owner = [words.hash], [words.text]
    for k in PREFIXES:
        long = np.flatnonzero(words.end - words.start > k)
        head = np.zeros(len(long), np.uint64)
        for j in range(k):
            head = head * np.uint64(257) + words.data[words.start[long] + j]
        hashes.append(mix(head, k))
        owner.append(words.text[long])
    bucket = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    pair = np.unique(np.concatenate(owner) * (1 << BITS) + bucket)
    one_word = bucket[: len(words.hash)]
    text, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
    distinct = np.bincount(text, minlength=len(texts))
    value = np.ones(len(text))
    plain = words_of(texts, SPACES)
    n_words = np.maximum(np.diff(plain.first), 1)
    own = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    symbol = np.bincount(own, weights=np.isin(data, SYMBOLS), minlength=len(texts)) / n_words
    lines = np.bincount(own, weights=data == 10, minlength=len(texts)) / n_words
    forms = np.bincount(np.unique(words.text * (1 << BITS) + one_word) >> BITS, minlength=len(texts))
    repeated = 1 - forms / np.maximum(np.diff(words.first), 1)
    length = np.fromiter(map(len, texts), np.float64, len(texts)) / n_words
    step = lambda x, edges: sum((x > e).astype(np.float64) for e in edges)
    shape = np.stack([
        np.minimum(symbol, 2), step(symbol, (0.05, 0.2, 0.5)), np.minimum(lines, 1), step(lines, (0.1, 0.3)), repeated, step(repeated, (0.5, 0.8)),
        step(length, (3, 4.5, 6, 8, 12)) / 5, step(n_words, (5, 10, 20, 50, 100, 500)) / 6, (n_words < 10).astype(np.float64),
    ], axis=1)
    k = shape.shape[1]
    order = np.argsort(np.concatenate([text, np.repeat(np.arange(len(texts)), k)]), kind="stable")
    feature = np.concatenate([bucket, np.tile((1 << BITS) + np.arange(k), len(texts))])[order]
    value = np.concatenate([value, shape.ravel()])[order]
    return np.concatenate([[0], np.cumsum(distinct + k)]), feature, value


@dataclass
class Ordinal:
    """Shared weights and ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade > k) of each row, for each threshold k."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[feature] * value)])
        score = sums[first[1:]] - sums[first[:-1]]
        return 1 / (1 + np.exp(-(score[:, None] - self.thresholds)))


def fit(first: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> Ordinal:
    """Weights and thresholds of least penalised negative log likelihood, by Adam over all rows."""
    n, width = len(grade), (1 << BITS) + SHAPES
    row = np.repeat(np.arange(n), np.diff(first))
    known = np.bincount(feature, minlength=width) >= LEAST_DOCS
    share = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(0.01, 0.99)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-6 * np.arange(grades - 1))
    w, low, gaps = np.zeros(width), start[0], np.log(np.maximum(np.diff(start), 1e-2))
    state = [np.zeros(width), np.zeros(width), np.zeros(grades - 1), np.zeros(grades - 1)]
    every = np.arange(n)
    for t in range(1, STEPS + 1):
        cut = low + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(row, weights=w[feature] * value, minlength=n)
        up = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-(score[:, None] - cut))), np.zeros((n, 1))], axis=1)
        p = np.maximum(up[every, grade] - up[every, grade + 1], 1e-9)
        slope = up * (1 - up)  # of each tail, by the score
        by_score = -(slope[every, grade] - slope[every, grade + 1]) / p / n
        by_cut = np.array([(-(np.where(grade == k, slope[:, k + 1], 0) - np.where(grade == k + 1, slope[:, k + 1], 0)) / p).mean() for k in range(grades - 1)])
        by_w = np.bincount(feature, weights=by_score[row] * value, minlength=width) * known + RIDGE * w
        by_low = np.concatenate([[by_cut.sum()], [by_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(grades - 2)]])
        for grad, i in ((by_w, 0), (by_low, 2)):
            state[i] = 0.9 * state[i] + 0.1 * grad
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * grad**2
        move = lambda i: RATE * (state[i] / (1 - 0.9**t)) / (np.sqrt(state[i + 1] / (1 - 0.999**t)) + 1e-8)  # noqa: E731, B023
        w = w - move(0)
        step = move(2)
        low, gaps = low - step[0], gaps - step[1:]
    return Ordinal(w, low + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def rated(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", n: int = SAMPLE_DOCS) -> DataFrame:
    """(text, grade): rated documents of the smallest hashes. Toxic is grade 0, else low quality 1, else good 2.

    Rows without a rating or text are left out; of several ratings of a document the lowest counts, of several texts
    the least. A document has one row, and all together have the bytes that ``sample`` allows.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    known = labels.select(F.col(key).alias("_k"), grade.alias("grade")).where("grade IS NOT NULL AND _k IS NOT NULL").groupBy("_k").agg(F.min("grade").alias("grade"))
    some = known.orderBy(F.xxhash64("_k"), "_k").limit(n)  # n rows at most
    texts = sample(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).join(F.broadcast(some), F.col(key) == F.col("_k"), "left_semi"), key, text, n)
    return texts.join(F.broadcast(some), F.col(key) == F.col("_k")).select(F.col(text).alias("text"), "grade")


def train(docs: DataFrame, labels: DataFrame, grades: int = 3, **more) -> Ordinal:
    """The classifier of the rated documents; without any, every grade is as likely."""

    def compute(given: pa.Table) -> list:
        out = []
        texts = utf8(given.column(0))
        for a, b in chunks(texts):
            first, feature, value = features(texts[a:b])
            out += [(feature[i:j].astype(np.int32).tobytes(), value[i:j].astype(np.float32).tobytes()) for i, j in zip(first, first[1:], strict=False)]
        return [pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())]

    rows = append(rated(docs, labels, **more), [T.StructField("f", T.BinaryType()), T.StructField("v", T.BinaryType())], compute, ["text"], keep=["grade"]).collect()
    if not rows:
        return Ordinal(np.zeros((1 << BITS) + SHAPES), -np.log(np.arange(grades - 1, 0, -1) / np.arange(1, grades)))
    rows.sort(key=lambda r: (r.grade, bytes(r.f)))  # the fit does not depend on the order of tasks
    feature = np.concatenate([np.frombuffer(r.f, np.int32) for r in rows]).astype(np.int64)
    value = np.concatenate([np.frombuffer(r.v, np.float32) for r in rows]).astype(np.float64)
    first = np.concatenate([[0], np.cumsum([len(r.f) // 4 for r in rows])])
    return fit(first, feature, value, np.array([r.grade for r in rows]), grades)


def grade(docs: DataFrame, model: Ordinal, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with expected_grade and p_above_0, p_above_1, ...: null and empty texts are scored as texts without words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed width

    def compute(given: pa.Table) -> list:
        texts = utf8(given.column(0))
        tails = [sent.value.above(*features(texts[a:b])) for a, b in chunks(texts)]
        tail = np.concatenate(tails) if tails else np.zeros((0, len(sent.value.thresholds)))
        return [pa.array(tail.sum(axis=1)), *[pa.array(np.ascontiguousarray(tail[:, k])) for k in range(tail.shape[1])]]

    fields = [T.StructField(c, T.DoubleType()) for c in ("expected_grade", *[f"p_above_{k}" for k in range(len(model.thresholds))])]
    return append(docs, fields, compute, [text], keep=keep)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document; kept if its chance of the top grade is KEEP or more."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    found = grade(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.withColumn("kept", F.col("p_above_1") >= KEEP)
