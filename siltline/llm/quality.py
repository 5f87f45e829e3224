"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's state score is linear in its own features and those
of the lines before and after it; a 2x2 matrix scores neighbouring labels. Only documents carry
labels, so in training every line takes its document's. A document's quality is the mean of its
lines' forward-backward marginals of "good", weighted by line length, mapped to a probability by
a logistic curve fitted on the learning documents.

Learning reads a bounded sample of labelled documents (``most`` of them, the smallest hashes of
their ids, and about ``most_bytes`` of text); scoring reads every text whole, a very long one line by
line in one task. Null and empty texts are one line of length zero. Repeated rows and rows without an
id are scored each for itself; these teach nothing, nor does a document whose labels disagree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.llm.common import bounded_batches, bytes_of, slices, text_bytes, thrifty

BREAK = re.compile(rb"[\r\n]+")
#: Classes of bytes: lower-case letters, capitals, digits, white space, sentence marks, other signs, bytes of non-ASCII letters.
CLASSES = 7
KIND = np.full(256, 5, np.uint8)
KIND[ord("a") : ord("z") + 1], KIND[ord("A") : ord("Z") + 1], KIND[ord("0") : ord("9") + 1], KIND[0x80:] = 0, 1, 2, 6
KIND[[9, 10, 11, 12, 13, 32]] = 3
KIND[[ord(c) for c in ".,;:?'\"-()"]] = 4
KNOTS = (0.02, 0.1, 0.25, 0.5)
FEATURES = 2 + CLASSES + 3
WIDTH = FEATURES + 6 * len(KNOTS)


@dataclass(frozen=True)
class LineCrf:
    """weights: 3 x WIDTH + 1 for the label good; transitions[a, b] from a to b; curve: slope and offset."""

    weights: np.ndarray
    transitions: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their weights (bytes, one at least), and the number of lines of each text."""
    lines, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = [x for x in BREAK.split(text) if x] or [b""]
        counts[i] = len(own)
        lines += own
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(size + 1) - size - 1
    kind = KIND[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    share = np.empty((len(lines), CLASSES))
    for c in range(CLASSES):
        share[:, c] = np.add.reduceat(kind == c, start, dtype=np.int64)
    share[:, 3] -= 1  # the line's own break
    words = np.empty((len(lines), 3))
    document = np.repeat(np.arange(len(texts)), counts)
    seen: set[bytes] = set()
    before = -1
    for i, line in enumerate(lines):
        own = line.split()
        if document[i] != before:
            before, seen = document[i], set()
        words[i] = len(own), len(set(own)), line in seen
        seen.add(line)
    share /= np.maximum(size, 1)[:, None]
    n = np.maximum(words[:, 0], 1)
    repeats = 1 - words[:, 1] / n
    x = np.empty((len(lines), WIDTH), np.float32)
    x[:, 0] = np.log1p(size) / 6
    x[:, 1] = np.minimum(size / n, 30) / 10
    x[:, 2 : 2 + CLASSES] = share
    x[:, 2 + CLASSES] = repeats
    x[:, 3 + CLASSES] = words[:, 2]
    x[:, 4 + CLASSES] = np.log1p(words[:, 0]) / 4
    at = FEATURES
    for column in (share[:, 1], share[:, 2], share[:, 4], share[:, 5], share[:, 6], repeats):
        for knot in KNOTS:
            x[:, at] = column > knot
            at += 1
    return x, np.maximum(size, 1).astype(np.float64), counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of the line, of the one before and of the one after (zeros at the ends), and a constant."""
    out = np.zeros((len(x), 3 * x.shape[1] + 1), np.float32)
    w, first = x.shape[1], np.cumsum(counts) - counts
    out[:, :w], out[1:, w : 2 * w], out[:-1, 2 * w : 3 * w], out[:, -1] = x, x[:-1], x[1:], 1
    out[first, w : 2 * w] = 0
    out[first + counts - 1, 2 * w : 3 * w] = 0
    return out


def forward_backward(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log marginals [lines, 2], expected transitions [2, 2] summed, and log Z per document.

    ``scores`` is the state score of good (bad's is zero). Documents advance together, line by line.
    """
    order = np.argsort(-counts, kind="stable")
    n, first = counts[order], (np.cumsum(counts) - counts)[order]
    alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right") if len(n) else []
    state = np.stack([np.zeros_like(scores), scores], 1)
    alpha, beta = np.empty_like(state), np.zeros_like(state)
    for t, k in enumerate(alive):
        at = first[:k] + t
        alpha[at] = state[at] if t == 0 else state[at] + np.logaddexp(alpha[at - 1][:, :1] + transitions[0], alpha[at - 1][:, 1:] + transitions[1])
    expected = np.zeros((2, 2))
    log_z = np.empty(len(counts))
    last = first + n - 1
    log_z[order] = np.logaddexp(alpha[last, 0], alpha[last, 1])
    z = np.repeat(log_z, counts)
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        into = state[at] + beta[at]
        beta[at - 1] = np.stack([np.logaddexp(transitions[a, 0] + into[:, 0], transitions[a, 1] + into[:, 1]) for a in (0, 1)], 1)
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] += np.exp(alpha[at - 1, a] + transitions[a, b] + into[:, b] - z[at]).sum()
    return alpha + beta - z[:, None], expected, log_z


def train_crf(texts: list[bytes], labels: np.ndarray, steps: int = 120, rate: float = 0.08, decay: float = 1e-3) -> LineCrf:
    """Adam on the mean log-likelihood per line, each document weighted alike within its label."""
    x, size, counts = line_features(texts)
    x = with_neighbours(x, counts)
    y = np.repeat(labels, counts).astype(np.float64)
    weights, transitions = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros((2, 2)), np.zeros((2, 2))]
    pairs = counts - 1
    seen = np.diag([float(pairs[labels == 0].sum()), float(pairs[labels == 1].sum())])
    lines = max(len(x), 1)
    for step in range(1, steps + 1):
        log_p, expected, _ = forward_backward(x @ weights.astype(np.float32), counts, transitions)
        for i, (value, slope) in enumerate(((weights, x.T @ (y - np.exp(log_p[:, 1])).astype(np.float32) / lines - decay * weights), (transitions, (seen - expected) / lines - decay * transitions))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    crf = LineCrf(weights, transitions)
    raw = raw_quality(texts, crf)
    return LineCrf(weights, transitions, fit_curve(raw, labels))


def raw_quality(texts: list[bytes], crf: LineCrf) -> np.ndarray:
    """Log-odds of the length-weighted mean marginal of good."""
    x, size, counts = line_features(texts)
    log_p, _, _ = forward_backward(with_neighbours(x, counts) @ crf.weights.astype(np.float32), counts, crf.transitions)
    first = np.cumsum(counts) - counts
    mean = np.add.reduceat(np.exp(log_p[:, 1]) * size, first) / np.add.reduceat(size, first)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def fit_curve(raw: np.ndarray, labels: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton's method, with a weak pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(steps // 10):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = p * (1 - p)
        slope = np.array([((labels - p) * raw).sum() - (a - 1), (labels - p).sum() - 0.01 * b])
        bend = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.01]])
        da, db = np.linalg.solve(bend, slope)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -2, 2)
    return max(float(a), 1e-3), float(b)


def quality_scores(texts: list[bytes], crf: LineCrf) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(crf.curve[0] * raw_quality(texts, crf) + crf.curve[1], -30, 30)))


def learning_sample(docs: DataFrame, chosen: DataFrame, key: str, text: str, most: int, most_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of the documents ``chosen`` (k, y): ``most`` rows and about ``most_bytes`` bytes of text, in order of the id's hash."""
    rows = docs.select(F.col(key).cast("long").alias("k"), text_bytes(text).alias("t")).join(F.broadcast(chosen), "k")
    first = rows.select("k", "t", "y", F.xxhash64("k").alias("h")).orderBy("h", "k").limit(most)
    before = Window.orderBy("h", "k").rowsBetween(Window.unboundedPreceding, -1)  # ``most`` rows
    kept = first.withColumn("before", F.coalesce(F.sum(F.octet_length("t")).over(before), F.lit(0))).where(F.col("before") < most_bytes)
    rows = kept.select("t", "y").toPandas()
    return list(rows["t"]), rows["y"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)


def agreed_labels(labels: DataFrame, key: str, label: str, keep: Column) -> DataFrame:
    """(k, y) of the ids whose labels all agree and that ``keep``, a condition on k, lets through."""
    marks = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1))
    return marks.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("k", "y").where(keep)


def train_quality(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, keep: Column, most: int = 2500, most_bytes: int = 64 << 20) -> LineCrf:
    """``keep`` is a condition on the id, called k. Without both labels the model scores all alike."""
    chosen = agreed_labels(labels, key, label, keep).orderBy(F.xxhash64("k"), "k").limit(most)
    texts, marks = learning_sample(docs, chosen, key, text, most, most_bytes)
    if len(set(marks.tolist())) < 2:
        share = float(np.clip(marks.mean() if len(marks) else 0.5, 0.05, 0.95))
        return LineCrf(np.zeros(3 * WIDTH + 1), np.zeros((2, 2)), (1.0, float(np.log(share / (1 - share)))))
    return train_crf(texts, marks)


def score_quality(docs: DataFrame, text: str, crf: LineCrf, keys: list[str], name: str = "score") -> DataFrame:
    """The columns ``keys`` and the quality of each text, read whole."""
    bounded_batches(docs.sparkSession)
    own = keys if text in keys else [*keys, text]  # a text among the columns kept is not sent twice
    rows = docs.select(*[(F.col(c).cast("string") if c == text else F.col(c)).alias(f"k{i}") for i, c in enumerate(own)])
    at, schema = own.index(text), T.StructType([*rows.schema.fields[: len(keys)], T.StructField("score", T.DoubleType())])

    def score(batches):
        for batch in batches:
            texts = bytes_of(batch.column(at))
            values = np.empty(len(texts))
            for a, b in slices(texts):
                values[a:b] = quality_scores(texts[a:b], crf)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(values)], names=[*(f"k{i}" for i in range(len(keys))), "score"])

    scored = rows.mapInArrow(thrifty(score), schema)
    return scored.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("score").alias(name))
