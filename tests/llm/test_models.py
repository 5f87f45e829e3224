from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltline.llm import quality, toxicity
from siltline.llm.common import fold

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts with labels: junk lines make quality 0, insults make toxic 1, one of them in the middle of a long text."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        text = prose(rng, rng.randrange(20, 150))
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if not good:
            text = "\n".join(" ".join(w + rng.choice(("%%%", "$$$")) for w in line.split()) for line in text.split("\n"))
        if toxic:
            words = text.split(" ")
            words.insert(rng.randrange(len(words)), rng.choice(("scum", "Idiot,", "moron!")))
            text = " ".join(words)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    labels += [(5, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels[:400]


def held_out_accuracy(scored, labels, which, held, bound):
    mark = {r[0]: r[which] for r in labels}
    own = [(r.score >= bound) == bool(mark[r.doc_id]) for r in scored.collect() if zlib.crc32(str(r.doc_id).encode()) % held[0] == held[1]]
    return np.mean(own)


def test_quality_on_held_out_rows(labelled, docs, awkward):
    rows, labels, plain = labelled
    crf = quality.train_quality(rows, labels, "doc_id", "text", "quality", fold("k", 4) != 2)
    assert held_out_accuracy(quality.score_quality(rows, "text", crf, ["doc_id"]), plain, 1, (4, 2), 0.7) > 0.95
    out = quality.score_quality(docs, "text", crf, docs.columns, "mark")
    assert out.columns == [*docs.columns, "mark"] and out.count() == len(awkward) and out.where("mark IS NULL OR mark < 0 OR mark > 1").count() == 0
    assert quality.score_quality(docs.where("false"), "text", crf, ["doc_id"]).count() == 0
    nothing = quality.train_quality(rows, labels.where("false"), "doc_id", "text", "quality", F.lit(True))
    assert quality.score_quality(rows, "text", nothing, ["doc_id"]).select(F.round("score", 6)).distinct().count() == 1


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    counts, transitions = np.array([1, 4, 3]), rng.standard_normal((2, 2))
    scores = rng.standard_normal(8)
    log_p, expected, log_z = quality.forward_backward(scores, counts, transitions)
    at, pairs = 0, np.zeros((2, 2))
    for d, n in enumerate(counts):
        weights = {}
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            weights[tuple(y)] = math.exp(sum(scores[at + i] for i in range(n) if y[i]) + sum(transitions[a, b] for a, b in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        assert math.log(z) == pytest.approx(log_z[d])
        for i in range(n):
            assert math.exp(log_p[at + i, 1]) == pytest.approx(sum(w for y, w in weights.items() if y[i]) / z)
        for y, w in weights.items():
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += w / z
        at += n
    assert np.allclose(pairs, expected)


def test_toxicity_on_held_out_rows(labelled, docs, awkward):
    rows, labels, plain = labelled
    net = toxicity.learn_toxicity(rows, labels, "doc_id", "text", "toxic", fold("k", 5) != 0)
    assert held_out_accuracy(toxicity.score_toxicity(rows, "text", net, ["doc_id"]), plain, 2, (5, 0), 0.5) > 0.9
    out = toxicity.score_toxicity(docs, "text", net, docs.columns, "mark")
    assert out.columns == [*docs.columns, "mark"] and out.count() == len(awkward) and out.where("mark IS NULL OR mark < 0 OR mark > 1").count() == 0
    rng = random.Random(2)
    clean = prose(rng, 3000)
    words = clean.split(" ")
    words.insert(1990, "scum")
    low, high, empty = toxicity.toxicity_scores([clean.encode(), " ".join(words).encode(), b""], toxicity.Lookup(net))
    assert high > 0.5 > low and empty < 0.5
    nothing = toxicity.learn_toxicity(rows, labels.where("false"), "doc_id", "text", "toxic", F.lit(True))
    assert toxicity.score_toxicity(rows, "text", nothing, ["doc_id"]).select(F.round("score", 6)).distinct().count() == 1


def test_toxic_terms_late_in_very_long_words():
    rng = random.Random(5)
    lessons = [prose(rng, 60) for _ in range(300)]
    marks = np.array([i % 3 == 0 for i in range(300)], np.int64)
    texts = [t + " scum" if y else t for t, y in zip(lessons, marks, strict=True)]
    lookup = toxicity.Lookup(toxicity.train_toxicity([t.encode() for t in texts], marks))
    for sign in ("\u00a0", "-", "_", "/", "\u3000"):
        clean = sign.join(prose(rng, 30).replace(".", "").split())
        low, high = toxicity.toxicity_scores([clean.encode(), f"{clean}{sign}scum".encode()], lookup)
        assert high > 0.5 > low, sign


def test_words_are_read_to_their_end():
    for n in (24, 25, 36, 37, 48, 1000):
        word = bytes(random.Random(n).choices(range(0x80, 0x100), k=n))
        parts = toxicity.words_in(b"a " + word + b" b")[1:-1]
        assert max(map(len, parts)) <= toxicity.LONGEST
        assert all(any(word[a : a + 12] in p for p in parts) for a in range(n - 11))
    assert toxicity.words_in(b"-" * 30) == toxicity.words_in(b"") == []


def test_toxicity_gradients_by_differences():
    rng = np.random.default_rng(1)
    words = [b"alpha", b"beta", b"gamma", b"delta"]
    net = toxicity.BiGru.new({w: i + 1 for i, w in enumerate(words[:3])}, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["gram"][toxicity.BUCKETS] = 0
    buckets, scale = toxicity.gram_buckets([b"", *words])
    table = (np.array([0, 1, 2, 3, 0]), buckets, scale)
    number = rng.integers(1, 5, (6, 3))
    mask = np.arange(6)[:, None] < np.array([6, 4, 1])[None, :]
    number = np.where(mask, number, 0)
    y = np.array([1, 0, 1], np.float32)
    _, g = toxicity.gradients(net, table, number, mask, y)
    for name in ("wf", "ub", "a", "v", "o", "bb"):
        at = tuple(int(rng.integers(0, s)) for s in net.p[name].shape)
        keep, step = net.p[name][at], 1e-3
        net.p[name][at] = keep + step
        up = toxicity.gradients(net, table, number, mask, y)[0]
        net.p[name][at] = keep - step
        down = toxicity.gradients(net, table, number, mask, y)[0]
        net.p[name][at] = keep
        assert (up - down) / (2 * step) == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-4)


def test_windows_reach_the_end():
    text, start, size = toxicity.windows_of(np.array([0, 5, toxicity.WINDOW, toxicity.WINDOW + 1, 500]))
    ends = {t: 0 for t in range(5)}
    for t, s, n in zip(text, start, size, strict=True):
        assert s <= ends[t] or s == 0
        ends[t] = s + n
    assert list(ends.values()) == [0, 5, toxicity.WINDOW, toxicity.WINDOW + 1, 500]
