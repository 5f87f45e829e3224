"""Toxicity and quality scores against plain Python, word by word and line by line."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from siltline.llm import quality, toxicity

from .conftest import prose

MASK = (1 << 64) - 1


def buckets_of(word: bytes) -> tuple[list[int], list[int]]:
    """Buckets of the 3- to 5-grams of ^word$, and of the word's first 4 to 9 bytes with its edge sign."""
    whole = b"^" + word[: toxicity.LONGEST] + b"$"

    def bucket(h: int) -> int:
        h ^= h >> 29
        return (h * 0x9E3779B97F4A7C15 & MASK) >> (64 - 15)

    grams, prefixes = [], []
    for n in (3, 4, 5):
        for i in range(len(whole) - n + 1):
            h = n
            for b in whole[i : i + n]:
                h = (h * 0x100000001B3 + b) & MASK
            grams.append(bucket(h))
    h = 77
    for n, b in enumerate(whole[: toxicity.PREFIXES[-1]], 1):
        h = (h * 0x100000001B3 + b) & MASK
        if n in toxicity.PREFIXES:
            prefixes.append(bucket(h))
    return grams, prefixes


def slow_toxicity(net, text: bytes) -> float:
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(word: bytes) -> np.ndarray:
        core = word.strip(toxicity.EDGE).lower()
        grams, prefixes = buckets_of(core)
        chars = sum((p["gram"][b] for b in grams), np.zeros(toxicity.CHAR_DIM)) / math.sqrt(max(len(grams), 1)) + sum((p["gram"][b] for b in prefixes), np.zeros(toxicity.CHAR_DIM)) / math.sqrt(len(toxicity.PREFIXES))
        return np.concatenate([p["word"][net.vocabulary.get(core, 0)], chars])

    def states(xs, side):
        h, out, n = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for x in xs:
            a, up = x @ p[f"w{side}"] + p[f"b{side}"], h @ p[f"u{side}"]
            z, r = sigmoid(a[:n] + up[:n]), sigmoid(a[n : 2 * n] + up[n : 2 * n])
            new = np.tanh(a[2 * n :] + r * up[2 * n :])
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    words, worst = toxicity.words_in(text), -math.inf
    start = 0
    while True:
        own = words[start : start + toxicity.WINDOW]
        xs = [vector(w) for w in own]
        if xs:
            both = np.concatenate([np.array(states(xs, "f")), np.array(states(xs[::-1], "b")[::-1])], 1)
            e = np.tanh(both @ p["a"]) @ p["v"]
            weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            worst = max(worst, float(weight @ both @ p["o"] + p["c"][0]))
        else:
            worst = max(worst, float(p["c"][0]))
        if start + toxicity.WINDOW >= len(words):
            break
        start += toxicity.STEP
    return float(sigmoid(np.clip(net.curve[0] * worst + net.curve[1], -30, 30)))


def test_toxicity_scores_word_by_word():
    rng = random.Random(3)
    lessons = [prose(rng, rng.randrange(10, 80)) for _ in range(120)]
    marks = np.array([i % 3 == 0 for i in range(120)], np.int64)
    net = toxicity.train_toxicity([(t + " scum" if y else t).encode() for t, y in zip(lessons, marks, strict=True)], marks, rounds=2)
    texts = [b"", b" ", b"scum", b"...", lessons[0].encode(), (prose(rng, 31) + " Scum!").encode(), prose(rng, 32).encode(), prose(rng, 200).encode(), "É ñ日本 x-y".encode(), b"q" * 200]
    got = toxicity.toxicity_scores(texts, toxicity.Lookup(net))
    for text, score in zip(texts, got, strict=True):
        if toxicity.words_in(text):
            assert score == pytest.approx(slow_toxicity(net, text), abs=2e-3), text[:40]
    assert got[0] == pytest.approx(got[1])


def slow_features(lines: list[bytes]) -> list[list[float]]:
    kinds = lambda line: [sum(quality.KIND[b] == c for b in line) / max(len(line), 1) for c in range(quality.CLASSES)]
    out = []
    for i, line in enumerate(lines):
        words, share = line.split(), kinds(line)
        repeats = 1 - len(set(words)) / max(len(words), 1)
        own = [math.log1p(len(line)) / 6, min(len(line) / max(len(words), 1), 30) / 10, *share, repeats, float(line in lines[:i]), math.log1p(len(words)) / 4]
        out.append(own + [float(v > knot) for v in (share[1], share[2], share[4], share[5], share[6], repeats) for knot in quality.KNOTS])
    return out


def slow_quality(crf, text: bytes) -> float:
    lines = [x for x in text.replace(b"\r", b"\n").split(b"\n") if x] or [b""]
    x, none = slow_features(lines), [0.0] * quality.WIDTH
    good = [float(np.dot(crf.weights, x[i] + (x[i - 1] if i else none) + (x[i + 1] if i + 1 < len(x) else none) + [1.0])) for i in range(len(x))]
    state = [np.array([0.0, g]) for g in good]
    alpha, beta = [state[0]], [np.zeros(2)]
    for s in state[1:]:
        alpha.append(np.array([s[b] + np.logaddexp(alpha[-1][0] + crf.transitions[0, b], alpha[-1][1] + crf.transitions[1, b]) for b in (0, 1)]))
    for s in state[:0:-1]:
        beta.append(np.array([np.logaddexp(crf.transitions[a, 0] + s[0] + beta[-1][0], crf.transitions[a, 1] + s[1] + beta[-1][1]) for a in (0, 1)]))
    z = np.logaddexp(*alpha[-1])
    weight = [max(len(line), 1) for line in lines]
    mean = sum(w * math.exp((a + b)[1] - z) for w, a, b in zip(weight, alpha, beta[::-1], strict=True)) / sum(weight)
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-min(max(crf.curve[0] * math.log(mean / (1 - mean)) + crf.curve[1], -30), 30)))


def test_quality_scores_line_by_line():
    rng = random.Random(4)
    lessons = [prose(rng, rng.randrange(10, 90)) for _ in range(100)]
    marks = np.array([i % 4 > 0 for i in range(100)], np.int64)
    bad = lambda t: "\n".join(" ".join(w + "%%" for w in line.split()) for line in t.split("\n"))
    crf = quality.train_crf([(t if y else bad(t)).encode() for t, y in zip(lessons, marks, strict=True)], marks, steps=30)
    texts = [b"", b"\n\r\n", b"one", lessons[0].encode(), bad(lessons[1]).encode(), ("\n".join([prose(rng, 12)] * 3) + "\n\n12 34").encode(), "É ñ\n日本 %%\r\nA".encode(), prose(rng, 500).encode()]
    got = quality.quality_scores(texts, crf)
    for text, score in zip(texts, got, strict=True):
        assert score == pytest.approx(slow_quality(crf, text), abs=2e-3), text[:40]
