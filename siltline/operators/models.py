"""Scorers and encoders as Arrow functions: a task loads its model once, and a failure costs values, not rows.

``load`` is a function without arguments that gives the model; it runs on the executors, when a task
meets its first batch. Where it raises, all values of the task are null. Where the model raises on a
batch, each row is tried by itself, and only those on which it raises again are null. Nulls in are nulls
out. A caller decides what a null means: the band without a score, a day without vectors.

``TermWeights`` is a model of this kind that is made here: how rare a term is in a corpus, counted in
Spark over 16 ** 4 classes of terms by hash, so its size does not depend on the corpus. A scorer and an
encoder use it.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.functions import text as T

Load = Callable[[], Callable[..., list]]
CLASSES, HEX = 1 << 16, 4
TOKEN, TERM = re.compile(T.WORD), re.compile(T.WORD.encode())
#: Words whose classes a task remembers.
REMEMBERED = 1 << 18


def _contained(model: Callable[..., list] | None, columns: list[list], check: Callable[[Any], bool]) -> list:
    """One value a row; null where an input is null, the model is missing or raises, or its value does not pass."""
    out: list = [None] * len(columns[0])
    rows = [i for i, row in enumerate(zip(*columns, strict=True)) if None not in row]
    if model is None or not rows:
        return out
    try:
        made = list(model(*[[c[i] for i in rows] for c in columns]))
        if len(made) != len(rows):
            raise ValueError("a value for each row is needed")
    except Exception:
        made = []
        for i in rows:
            try:
                (value,) = model(*[[c[i]] for c in columns])
            except Exception:
                value = None
            made.append(value)
    for i, value in zip(rows, made, strict=True):
        out[i] = value if value is not None and check(value) else None
    return out


def _loaded(load: Load) -> Callable[..., list] | None:
    try:
        return load()
    except Exception:
        return None


def scorer(load: Load, together: int = 256) -> Callable[[Column, Column], Column]:
    """A function of two text columns; the model takes two lists of texts and gives a list of finite numbers."""

    def finite(value) -> bool:
        return math.isfinite(value)

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model, started = None, False
        for premise, hypothesis in batches:
            if not started:
                model, started = _loaded(load), True
            out: list = []
            for a in range(0, len(premise), together):
                out += _contained(model, [premise[a : a + together].to_pylist(), hypothesis[a : a + together].to_pylist()], finite)
            yield pa.array(out, pa.float64())

    return lambda premise, hypothesis: score(premise, hypothesis)


def encoder(load: Load, dimensions: int, together: int = 64) -> Callable[[Column], Column]:
    """A function of a text column; the model takes a list of texts and gives as many vectors of ``dimensions``."""

    def whole(value) -> bool:
        return len(value) == dimensions and bool(np.isfinite(value).all())

    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, started = None, False
        for texts in batches:
            if not started:
                model, started = _loaded(load), True
            out: list = []
            for a in range(0, len(texts), together):
                out += _contained(model, [texts[a : a + together].to_pylist()], whole)
            yield pa.array([None if v is None else [float(x) for x in v] for v in out], pa.list_(pa.float64()))

    return lambda text: encode(text)


def tokens(text: str) -> list[str]:
    """The tokens of ``functions.text.tokens``."""
    return [w.lower().strip(".,") for w in TOKEN.findall(text)]


def overlap() -> Callable[[list[str], list[str]], list[float]]:
    """Share of the hypothesis's different tokens in the premise: a scorer that needs no model."""

    def score(premises: list[str], hypotheses: list[str]) -> list[float]:
        pairs = ((set(tokens(p)), set(tokens(h))) for p, h in zip(premises, hypotheses, strict=True))
        return [len(h & p) / len(h) if h else 0.0 for p, h in pairs]

    return score


def terms(text: str) -> set[bytes]:
    """The different tokens of a text; words are ASCII, so bytes are cut and lowered, and what repeats is stripped once."""
    return {w.strip(b".,") for w in set(TERM.findall(text.encode().lower()))}


@functools.lru_cache(REMEMBERED)
def term_class(term: str | bytes) -> int:
    return int(hashlib.md5(term.encode() if isinstance(term, str) else term).hexdigest()[:HEX], 16)


class TermWeights:
    """Weights of term classes, ln((1 + N) / (1 + n)) + 1 of N texts of which n have a term of the class."""

    def __init__(self, texts: int, counts: dict[int, int]) -> None:
        self.packed = zlib.compress(np.array([math.log((1 + texts) / (1 + counts.get(i, 0))) + 1 for i in range(CLASSES)]).tobytes())

    def __call__(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.packed))


def fit_terms(texts: DataFrame, text: str) -> TermWeights:
    """Counts over all texts, null ones too; a task sends its sums, and CLASSES rows at most come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for value in batch.column(0):
                n[list({term_class(w) for w in terms(value.as_py() or "")})] += 1
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], names=["c", "n"])

    counts = texts.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return TermWeights(texts.count(), {r["c"]: r["n"] for r in counts.collect()})


def weighted_overlap(weights: TermWeights) -> Load:
    """Scorer: the share of the hypothesis's term weights that the premise has too."""

    def load():
        known = weights()

        def score(premises: list[str], hypotheses: list[str]) -> list[float]:
            out = []
            for p, h in zip(premises, hypotheses, strict=True):
                own, there = terms(h), terms(p)
                worth = [(w, known[term_class(w)]) for w in own]
                total = math.fsum(x for _, x in worth)
                out.append(math.fsum(x for w, x in worth if w in there) / total if total else 0.0)
            return out

        return score

    return load


def hashed_vectors(weights: TermWeights, dimensions: int) -> Load:
    """Encoder: terms and pairs of neighbouring terms, each at two places by its hash with a sign, weighted and scaled to length 1."""

    def load():
        known = weights()

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions))
            for row, text in zip(out, texts, strict=True):
                words = tokens(text)
                for term, n in Counter([*words, *map(" ".join, zip(words, words[1:], strict=False))]).items():
                    digest = hashlib.md5(term.encode()).digest()
                    weight = (1 + math.log(n)) * known[int.from_bytes(digest[:2], "big")] * (0.5 if " " in term else 1.0)
                    for a in (2, 6):
                        place = int.from_bytes(digest[a : a + 4], "big")
                        row[(place >> 1) % dimensions] += weight if place & 1 else -weight
                length = np.linalg.norm(row)
                row /= length if length else 1.0
            return out

        return encode

    return load
