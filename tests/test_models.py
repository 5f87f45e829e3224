"""Scorers and encoders that are loaded by tasks: failures cost values, not rows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.operators import metrics, models

TEXTS = ["The grid, the GRID. Reactors-2", "reactors are small", "", "grid reactors grid", "naïve é 42.5", None]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t, TEXTS[(i + 1) % len(TEXTS)]) for i, t in enumerate(TEXTS)], "i int, a string, b string").repartition(2).cache()


def values(df, column):
    return {r.i: r.x for r in df.select("i", column.alias("x")).collect()}


def test_loaded_once_a_task_and_same_as_expressions(spark, df):
    count = spark.sparkContext.accumulator(0)

    def load():
        count.add(1)
        return models.overlap()

    many = spark.range(20_000, numPartitions=3).selectExpr("cast(id as string) AS a", "cast(id % 7 as string) AS b")
    assert many.where(models.scorer(load)(F.col("a"), F.col("b")).isNull()).count() == 0 and count.value == 3
    want = values(df, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), metrics.overlap_scorer(F.col("a"), F.col("b"))))
    assert values(df, models.scorer(models.overlap)(F.col("a"), F.col("b"))) == pytest.approx(want)
    assert [models.tokens(t) for t in TEXTS if t] == [r.x for r in df.where("a <> ''").orderBy("i").select(T.tokens(F.col("a")).alias("x")).collect()]


def test_failures_are_contained(df):
    def no_model():
        raise OSError("no weights")

    def picky():
        def score(a, b):
            if any("small" in x for x in a):
                raise ValueError("cannot read")
            return [float("nan") if x == "" else 1.0 for x in a]

        return score

    assert set(values(df, models.scorer(no_model)(F.col("a"), F.col("b"))).values()) == {None}
    assert values(df, models.scorer(picky)(F.col("a"), F.col("b"))) == {0: 1.0, 1: None, 2: None, 3: 1.0, 4: None, 5: None}
    assert set(values(df, models.encoder(lambda: lambda t: [[1.0]] * len(t), 2)(F.col("a"))).values()) == {None}
    low = metrics.score_over_chunks(df.withColumnsRenamed({"a": "source_text", "b": "summary"}), models.scorer(no_model), "i")
    assert {r.score for r in low.collect()} == {0.0} and low.count() == len(TEXTS)


def test_equal_texts_are_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def score(a, b):
            calls.add(len(a))
            return [float(len(x)) for x in a]

        return score

    rows = spark.createDataFrame([("s", "seen", "seen"), ("s", "seen", "seen and more"), ("s", "", "x")], "s string, a string, b string").coalesce(1)
    first, full = metrics.dual_score(models.scorer(load), F.col("s"), F.col("a"), F.col("b"))
    assert [tuple(r) for r in rows.select(first, full).collect()] == [(4.0, 4.0), (4.0, 13.0), (0.0, 1.0)] and calls.value == 5


def test_weights_and_vectors(spark, df):
    weights = models.fit_terms(df, "a")
    sets = [{models.term_class(w) for w in models.tokens(t or "")} for t in TEXTS]
    n = Counter(c for s in sets for c in s)
    known = weights()
    assert all(known[c] == pytest.approx(math.log((1 + len(TEXTS)) / (1 + n[c])) + 1) for c in [*n, 5]) and len(known) == models.CLASSES
    vectors = values(df, models.encoder(models.hashed_vectors(weights, 16), 16)(F.col("a")))
    for i, text in enumerate(TEXTS):
        if text is None:
            assert vectors[i] is None
            continue
        words, want = models.tokens(text), np.zeros(16)
        for term, count in Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]).items():
            d = hashlib.md5(term.encode()).hexdigest()
            for part in (d[4:12], d[12:20]):
                sign = 1 if int(part, 16) % 2 else -1
                want[(int(part, 16) // 2) % 16] += sign * (1 + math.log(count)) * known[int(d[:4], 16)] * (0.5 if " " in term else 1)
        want = want / np.linalg.norm(want) if want.any() else want
        assert vectors[i] == pytest.approx(list(want))
    share = values(df, models.scorer(models.weighted_overlap(weights))(F.col("a"), F.col("b")))
    worth = lambda words: sum(known[models.term_class(w)] for w in words)
    want = {i: (worth(set(models.tokens(b)) & set(models.tokens(a))) / worth(set(models.tokens(b))) if models.tokens(b) else 0.0) if a is not None and b is not None else None for i, (a, b) in enumerate(zip(TEXTS, TEXTS[1:] + TEXTS[:1], strict=True))}
    assert share == pytest.approx(want)


def test_terms_are_the_tokens_and_tasks_send_sums(spark):
    texts = ["It's A.B., a 1,000. \u212a K k", "", None, "stra\u00dfe \u0130x A a. a,", "q " * 500]
    for t in texts:
        assert models.terms(t or "") == {w.encode() for w in models.tokens(t or "")}
    df = spark.createDataFrame([(t,) for t in texts] * 20, "text string").repartition(3)
    want = {}
    for t in texts:
        for c in {models.term_class(w.encode()) for w in models.tokens(t or "")}:
            want[c] = want.get(c, 0) + 20
    assert (models.fit_terms(df, "text")() == models.TermWeights(100, want)()).all()

