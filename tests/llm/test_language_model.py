from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltline.llm import lm
from siltline.llm.common import fold

from .conftest import prose


def words_of(text):
    return [*(text or "").encode().lower().split(), b""]


def test_base_scores_by_hand(docs, awkward, monkeypatch):
    for places in (lm.PLACES, 50):  # few places: most counts come by the join
        monkeypatch.setattr(lm, "PLACES", places)
        out = lm.score_texts(docs, "doc_id", "text", fold("k", 5) != 1).toPandas()
        learn = [t for i, t in awkward if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
        counts = Counter(w for t in learn for w in words_of(t))
        total, distinct = sum(counts.values()), len(counts)
        want = Counter()
        for i, t in awkward:
            own = words_of(t)
            want[i, len(own), sum(counts[w] > 0 for w in own), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own), 4)] += 1
        got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out.itertuples())
        assert got == want and np.isfinite(out.score).all() and (out.score < 0).all()


def slow_score(p, vocabulary, counts, text):
    """log10 probability of a text, token by token: the whole softmax of classes, then the word in its class."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    edges, n, h = vocabulary.edges, vocabulary.n_listed, lm.HIDDEN
    rank = {int(k): int(r) for k, r in zip(vocabulary.keys, vocabulary.listed, strict=True) if r >= 0}
    token_of = lambda w: rank.get(lm.word_key(w), n + (lm.word_key(w) & 31))
    state, before, out = np.zeros(h), token_of(b""), 0.0
    for word in words_of(text):
        x, up = p["e"][before] @ p["w"] + p["b"], state @ p["u"]
        z, r = sigmoid(x[:h] + up[:h]), sigmoid(x[h : 2 * h] + up[h : 2 * h])
        new = np.tanh(x[2 * h :] + r * up[2 * h :])
        state = (1 - z) * new + z * state
        token = token_of(word)
        classes = np.exp(state @ p["wc"] + p["bc"])
        own = next((c for c in range(len(edges) - 1) if edges[c] <= token < edges[c + 1]), len(edges) - 1 + token - n)
        out += math.log10(classes[own] / classes.sum())
        if token < n:
            inside = np.exp(p["ww"][edges[own] : edges[own + 1]] @ state + p["bw"][edges[own] : edges[own + 1]])
            out += math.log10(inside[token - edges[own]] / inside.sum())
        else:
            out += math.log10((counts[word] + 0.5) / vocabulary.open_mass[token - n])
        before = token
    return out


def test_scores_against_a_slow_computation(docs, awkward, monkeypatch):
    kept = {}
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda rows, vocabulary: kept.setdefault("v", (vocabulary, fit(rows, vocabulary)))[1])
    monkeypatch.setattr(lm, "PLACES", 200)  # some words are open with counts that come by the join
    out = lm.score_texts(docs, "doc_id", "text", fold("k", 5) != 1).toPandas()
    vocabulary, p = kept["v"]
    assert 0 < vocabulary.n_listed <= len(vocabulary.keys) < vocabulary.distinct
    learn = [t for i, t in awkward if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in learn for w in words_of(t))
    p = {k: x.astype(np.float64) for k, x in p.items()}
    want = {i: slow_score(p, vocabulary, counts, t) for i, t in awkward if i is not None and i != 10}
    got = {int(r.doc_id): r.score for r in out.itertuples() if r.doc_id == r.doc_id}
    for i, value in want.items():
        assert got[i] == pytest.approx(value, rel=1e-4, abs=1e-3), i


def chained(rng, n):
    """Words that mostly follow from the one before."""
    out = [0]
    for _ in range(n - 1):
        out.append((out[-1] * 7 + 3) % 30 if rng.random() < 0.9 else rng.randrange(30))
    return " ".join(f"w{x}" for x in out)


def test_held_out_scores_beat_the_base(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, chained(rng, 120)) for i in range(1500)], "doc_id long, text string").repartition(4)
    out = lm.score_texts(df, "doc_id", "text", fold("k", 5) != 1).withColumn("held", fold("doc_id", 5) == 1)
    row = out.where("held").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    score, base = (-x / row.n * math.log2(10) for x in (row.s, row.b))
    assert base > 4.5 and score < base - 1.5, (score, base)


def test_every_learning_text_is_read_once_over_the_rounds(spark, monkeypatch):
    df = spark.createDataFrame([(f"word{i} again".encode(),) for i in range(300)], "t binary").repartition(4)
    vocabulary = lm.Vocabulary.of(lm.token_counts(df))
    saved, learners = lm.saved, set()
    for per in (lm.PER_WEIGHT, 0.001):
        monkeypatch.setattr(lm, "PER_WEIGHT", per)
        moves = []
        monkeypatch.setattr(lm, "saved", lambda rows, name, moves=moves: moves.append(saved(rows, name)) or moves[-1])
        lm.fit(df, vocabulary)
        assert len(moves) == lm.ROUNDS
        learners.add(max(m.where("name = 'b'").count() for m in moves))
        seen = sum(np.frombuffer(r.weight, np.float32).astype(np.float64).flat[0] for m in moves for r in m.where("name = 'b'").collect())
        assert seen == pytest.approx(900)  # 300 texts of two words and an end
    assert learners == {1, 4}


def test_nothing_to_score_or_to_learn_from(docs, awkward):
    assert lm.score_texts(docs.where("false"), "doc_id", "text", F.lit(True)).count() == 0
    out = lm.score_texts(docs, "doc_id", "text", F.lit(False)).toPandas()
    assert len(out) == len(awkward) and (out.train_tokens == 0).all() and (out.n_known == 0).all() and np.isfinite(out.score).all()


def test_model_sums_to_one(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, prose(rng, 200).encode()) for i in range(60)], "k long, t binary")
    vocabulary = lm.Vocabulary.of(lm.token_counts(df).cache())
    p = lm.fit(df, vocabulary)
    states = np.tanh(np.random.default_rng(0).standard_normal((3, lm.HIDDEN))).astype(np.float32)
    every = np.arange(vocabulary.n_listed + lm.SHAPES)
    for h in states:
        assert np.exp(lm.log_probabilities(p, vocabulary.edges, np.repeat(h[None], len(every), 0), every)).sum() == pytest.approx(1, abs=1e-3)
    inside = np.full(lm.SHAPES, 0.5)
    for key, c, listed in zip(vocabulary.keys, vocabulary.counts, vocabulary.listed, strict=True):
        inside[int(key) & 31] += (float(c) + 0.5) * (listed < 0)
    assert np.allclose(inside, vocabulary.open_mass)


def test_keys_tell_words_apart_wherever_they_stand(monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(0, 400)).encode() for _ in range(50)] + [b"", b" \n", b"a", "Straße É\u00a0x 日本".encode(), bytes(range(1, 256)), b"x" * 5000, b"x" * 4999, b"q" * 5000 + b" A a \x0b\x1cb"]
    for stride in (lm.STRIDE, 1000):
        monkeypatch.setattr(lm, "STRIDE", stride)
        monkeypatch.setattr(lm, "POWER", lm.powers(lm.BASE))
        monkeypatch.setattr(lm, "BACK", lm.powers(pow(lm.BASE, -1, 1 << 64)))
        keys, counts = lm.token_keys(texts)
        words = [w for t in texts for w in [*t.lower().split(), b""]]
        assert counts.tolist() == [len(t.split()) + 1 for t in texts] and len(keys) == len(words) and (keys >= 0).all()
        by_word = {}
        for w, k in zip(words, keys.tolist(), strict=True):
            assert by_word.setdefault(w, k) == k
        assert len(set(by_word.values())) == len(by_word) and by_word[b""] == lm.END
        assert [lm.word_key(w) for w in (b"straSSe", b"x" * 5000)] == [by_word.get(b"strasse", lm.word_key(b"strasse")), by_word[b"x" * 5000]]


def small_vocabulary(counts):
    return lm.Vocabulary(int(sum(counts)), 3, 1, np.array([32, 64, 96]), np.array(counts), np.array([0, 1, 2]), np.array([0, 1, 3]), np.full(lm.SHAPES, 0.5))


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(2)
    vocabulary = small_vocabulary([50, 30, 20])
    p = lm.new_weights(vocabulary)
    p["u"] *= 3
    counts = np.array([3 * lm.WINDOW + 5, 1, lm.WINDOW])
    tokens = rng.integers(0, 3, counts.sum())
    at = 0
    for n, whole in zip(counts, lm.text_log_likelihood(p, vocabulary.edges, tokens, counts, 2, 2), strict=True):
        table, u = lm.halved(p)
        state, before, slow = np.zeros((1, lm.HIDDEN), np.float32), 2, 0.0
        for x in tokens[at : at + n]:
            state = lm.step(table[[before]], state, u)[0]
            slow += lm.log_probabilities(p, vocabulary.edges, state, np.array([x]))[0]
            before = x
        at += n
        assert whole == pytest.approx(slow, rel=1e-5)


def test_gradients_by_differences():
    """A step of plain descent moves the weights by the slope of the mean loss."""
    vocabulary = small_vocabulary([5, 3, 2])
    p = {k: x.astype(np.float64) for k, x in lm.new_weights(vocabulary).items()}
    y = np.random.default_rng(3).integers(0, 2, 6)
    loss = lambda p: -lm.text_log_likelihood(p, vocabulary.edges, y, np.array([len(y)]), 2)[0] / len(y)
    trainer = lm.Trainer(p, vocabulary.edges, 2)
    slopes = {}
    trainer._row_step = lambda name, rows, slope: slopes.setdefault(name, []).append((rows, slope))
    trainer._window(np.concatenate([[2], y[:-1]])[:, None], y[:, None], np.zeros((1, lm.HIDDEN)))
    slopes |= {k: m / 0.1 for k, (m, _) in trainer.dense.items()}
    scale = None
    rng = np.random.default_rng(1)
    for name in ("u", "w", "wc", "b", "e", "ww"):
        at = (0, *(int(rng.integers(0, s)) for s in p[name].shape[1:]))
        own = slopes[name][at] if name not in lm.ROWS else next(s for rows, s in slopes[name] if 0 in np.arange(10)[rows])[0 if name == "ww" else list(slopes["e"][0][0]).index(0)][at[1:]]
        keep = p[name][at]
        values = []
        for step in (5e-3, -5e-3):
            p[name][at] = keep + step
            values.append(loss(p))
        p[name][at] = keep
        want = (values[0] - values[1]) / 1e-2
        if name in lm.ROWS:
            assert float(own) == pytest.approx(want, rel=5e-2, abs=1e-4), name
        elif abs(want) > 1e-3:  # dense slopes may have been scaled together
            scale = scale or float(own) / want
            assert float(own) / want == pytest.approx(scale, rel=5e-2), name


def test_learning_lowers_the_loss():
    tokens = np.tile(np.array([0, 1, 0, 1, 1, 2]), 4000)
    vocabulary = small_vocabulary(np.bincount(tokens))
    p = lm.new_weights(vocabulary)
    text = tokens[: 6 * 20]
    before = lm.text_log_likelihood(p, vocabulary.edges, text, np.array([len(text)]), 2)[0]
    trainer = lm.Trainer(p, vocabulary.edges, 2)
    for _ in range(8):
        trainer.learn(tokens)
    assert lm.text_log_likelihood(trainer.p, vocabulary.edges, text, np.array([len(text)]), 2)[0] > before / 2


def test_a_long_text_looks_at_the_outputs_as_seldom_as_many_short_ones(monkeypatch):
    rng, calls, whole = np.random.default_rng(4), [], lm.log_probabilities
    monkeypatch.setattr(lm, "log_probabilities", lambda p, edges, states, token: calls.append(len(token)) or whole(p, edges, states, token))
    vocabulary = small_vocabulary([50, 30, 20])
    p, counts = lm.new_weights(vocabulary), np.array([700, 1, 40, 5000])
    tokens = rng.integers(0, 3, counts.sum())
    together = lm.text_log_likelihood(p, vocabulary.edges, tokens, counts, 2)
    assert calls == [len(tokens)]
    alone = [lm.text_log_likelihood(p, vocabulary.edges, part, np.array([len(part)]), 2)[0] for part in np.split(tokens, np.cumsum(counts)[:-1])]
    assert together == pytest.approx(alone, rel=1e-6)


def test_places_of_keys():
    rng, top = np.random.default_rng(5), (1 << 63) - 1
    for own in ([], [0], [top], [0, 1, 2, 3, top - 1, top], [*rng.integers(0, top, 5000), *range(0, 96, 32), 1 << 62, (1 << 62) - 1]):
        keys = np.unique(np.array(own, np.int64))
        vocabulary = lm.Vocabulary(1, 1, 1, keys, np.ones(len(keys), np.int64), np.full(len(keys), -1, np.int32), np.array([0]), np.ones(lm.SHAPES))
        asked = np.concatenate([keys, keys[keys < top] + 1, keys[keys > 0] - 1, np.array([0, top])])
        known = {int(k): i for i, k in enumerate(keys)}
        assert vocabulary.places(asked).tolist() == [known.get(int(k), -1) for k in asked]
        assert vocabulary.drawers[1].max(initial=0) == len(keys) and "drawers" not in vocabulary.__getstate__()


def test_texts_are_cut_once_and_learned_from_as_numbers(spark, docs):
    rows = docs.select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("t"), F.lit(True).alias("lesson")).coalesce(1)
    vocabulary = lm.Vocabulary.of(lm.token_counts(rows))
    coded = lm.encoded(rows, vocabulary).cache()
    texts = [bytes(r.t) for r in rows.collect()]
    keys, counts = lm.token_keys(texts)
    assert [r.n_tokens for r in coded.collect()] == counts.tolist()
    assert np.concatenate([np.frombuffer(r.tokens, vocabulary.kind) for r in coded.collect()]).tolist() == vocabulary.tokens(keys)[1].tolist()
    by_texts, by_numbers = lm.fit(rows.select("t"), vocabulary), lm.fit(coded.select("turn", "tokens"), vocabulary)
    for name, x in by_texts.items():
        assert np.allclose(x, by_numbers[name], atol=1e-3), name


def test_words_rows_move_together_and_not_class_by_class():
    vocabulary = lm.Vocabulary(3000, 300, 1, np.arange(300) << 5, np.full(300, 10), np.arange(300, dtype=np.int32), np.arange(0, 301, 3), np.full(lm.SHAPES, 0.5))
    trainer, calls = lm.Trainer(lm.new_weights(vocabulary), vocabulary.edges, 0), []
    step = trainer._row_step
    trainer._row_step = lambda name, rows, slope: calls.append(name) or step(name, rows, slope)
    tokens = np.random.default_rng(7).integers(0, 300, (lm.UNROLL, 50))
    trainer._window(tokens, tokens, np.zeros((50, lm.HIDDEN), np.float32))
    assert sorted(calls) == ["bw", "e", "ww"] and trainer.met["class"].sum() == tokens.size


def test_words_about_as_long_as_what_is_read_at_a_time():
    words = [x * n for n in (1, 7, 8, 9, 16, 17, 63, 64, 65, 200) for x in (b"a", b"b", b"\0")] + [b"a\0", b"a\0\0", b"a" * 63 + b"b", b"b" + b"a" * 63, "é".encode() * 32, "é".encode() * 33]
    keys = [lm.word_key(w) for w in words]
    assert len(set(keys)) == len(words)
    for before in range(9):
        assert lm.token_keys([b"x" * before + b" " + b" ".join(words).upper()])[0].tolist()[bool(before) :] == [*keys, lm.END]
    assert [k & 1 for k in keys] == [any(c >= 0x80 for c in w) for w in words]
