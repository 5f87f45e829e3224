"""Toxicity by a bidirectional gated recurrent network with attention pooling, written in numpy.

Words end at white space, also no-break and other Unicode spaces. One of more than LONGEST bytes is
cut at its signs, and what is still longer goes in parts of LONGEST bytes, PART apart, to its end;
each is a word of the text. A word's input joins a word vector (words of the learning sample; others share one) and a
character vector (hashed character 3- to 5-grams of ``^word$`` and its first 4 to 9 bytes, each sum
over the root of its number). A text is read in overlapping windows of WINDOW words, STEP apart, to its end; a forward
and a backward network run over each, attention pools their states, and a logistic unit scores the
window. A text's score is that of its worst window, mapped to a probability by a logistic curve.

Only documents carry labels, so a toxic document teaches through its worst window, chosen anew in
each round (at first by log-odds of its n-grams), a clean one through its worst and random ones.
Learning reads a bounded sample of labelled documents (``most`` of each label, the smallest hashes
of their ids, and about ``most_bytes`` of text); scoring reads every text whole, a very long one in many
windows in one task. Null and empty texts are one window of no words. Repeated rows and rows without an
id are scored each for itself; these teach nothing, nor does a document whose labels disagree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.llm.common import bounded_batches, bytes_of, ragged, slices, thrifty
from siltline.llm.quality import agreed_labels, fit_curve, learning_sample

WINDOW, STEP = 32, 24
BUCKETS = 1 << 15
WORD_DIM = CHAR_DIM = 10
HIDDEN = 10
LONGEST, PART = 24, 12
PREFIXES = (4, 5, 6, 7, 8, 9)
EDGE = b".,;:!?\"'()[]{}<>%&$#*|-_/\\~`^+=@"


#: No-break and other Unicode spaces in UTF-8, and what separates the words of a long one.
SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")
SIGNS = re.compile(rb"[^0-9A-Za-z'\x80-\xff]+")


def words_in(text: bytes) -> list[bytes]:
    """The words of a text, none longer than LONGEST bytes."""
    words = text.split() if text.isascii() else SPACES.sub(b" ", text).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out = []
    for word in words:
        if len(word) <= LONGEST:
            out.append(word)
            continue
        for part in filter(None, SIGNS.split(word)):
            out += [part[a : a + LONGEST] for a in range(0, max(1, len(part) - LONGEST + PART), PART)]
    return out


def core(word: bytes) -> bytes:
    """The word without signs at its ends, A-Z lowered."""
    return word.strip(EDGE).lower()


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's character n-grams in a row of fixed width; unused places hold BUCKETS."""
    width = LONGEST + 2
    raw = np.zeros((len(words), width), np.uint64)
    size = np.zeros(len(words), np.int64)
    flat = b"".join(b"^" + w[:LONGEST] + b"$" for w in words)
    size[:] = [min(len(w), LONGEST) + 2 for w in words]
    place = ragged(np.arange(len(words), dtype=np.int64) * width, size)
    raw.reshape(-1)[place] = np.frombuffer(flat, np.uint8)
    out = []
    for n in (3, 4, 5):
        h = np.full((len(words), width - n + 1), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + raw[:, j : width - n + 1 + j]
        h ^= h >> np.uint64(29)
        bucket = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)
        bucket[np.arange(width - n + 1)[None, :] + n > size[:, None]] = BUCKETS
        out.append(bucket)
    scale = (1 / np.sqrt(np.maximum(sum((x < BUCKETS).sum(1) for x in out), 1))).astype(np.float32)
    h = np.full(len(words), 77, np.uint64)
    for n in range(PREFIXES[-1]):
        h = h * np.uint64(0x100000001B3) + raw[:, n]
        if n + 1 in PREFIXES:
            own = h ^ (h >> np.uint64(29))
            own = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)
            own[size < n + 1] = BUCKETS
            out.append(own[:, None])
    return np.concatenate(out, 1), scale


def column_scale(scale: np.ndarray, columns: int) -> np.ndarray:
    """The factor of each n-gram and prefix of each word."""
    out = np.repeat(scale[:, None], columns, 1)
    out[:, -len(PREFIXES) :] = len(PREFIXES) ** -0.5
    return out


@dataclass
class BiGru:
    """Parameters by name; ``vocabulary`` gives the rows of the word vectors, row 0 is any other word."""

    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    curve: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def new(vocabulary: dict[bytes, int], seed: int = 7) -> BiGru:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.1), "gram": draw(BUCKETS + 1, CHAR_DIM, scale=0.1)}
        for side in "fb":
            p |= {f"w{side}": draw(d, 3 * h, scale=d**-0.5), f"u{side}": draw(h, 3 * h, scale=h**-0.5), f"b{side}": np.zeros(3 * h, np.float32)}
        p |= {"a": draw(2 * h, h, scale=(2 * h) ** -0.5), "v": draw(h, scale=h**-0.5), "o": draw(2 * h, scale=(2 * h) ** -0.5), "c": np.zeros(1, np.float32)}
        return BiGru(vocabulary, p)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        row = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        buckets, scale = gram_buckets(words)
        self.p["gram"][BUCKETS] = 0
        chars = np.zeros((len(words), CHAR_DIM), np.float32)
        for j in range(buckets.shape[1] - len(PREFIXES)):
            chars += self.p["gram"][buckets[:, j]]
        chars *= scale[:, None]
        for j in range(buckets.shape[1] - len(PREFIXES), buckets.shape[1]):
            chars += self.p["gram"][buckets[:, j]] * np.float32(len(PREFIXES) ** -0.5)
        return np.concatenate([self.p["word"][row], chars], 1), row, buckets, scale


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_side(x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool):
    """States [steps, windows, HIDDEN] for projected inputs [steps, windows, 3*HIDDEN]; absent words change nothing."""
    h = HIDDEN
    state = np.zeros((x.shape[1], h), np.float32)
    states, kept = np.empty((x.shape[0], x.shape[1], h), np.float32), []
    for t in range(x.shape[0]):
        up = state @ u
        zr = sigmoid(x[t, :, : 2 * h] + up[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(x[t, :, 2 * h :] + r * up[:, 2 * h :])
        new = n + z * (state - n)
        if mask is not None:
            new = np.where(mask[t][:, None], new, state)
        if keep:
            kept.append((state, z, r, n, up[:, 2 * h :]))
        state = states[t] = new
    return states, kept


def back_side(grad: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray):
    """Gradients of the projected inputs and of u."""
    h = HIDDEN
    dx = np.zeros((len(kept), grad.shape[1], 3 * h), np.float32)
    du = np.zeros_like(u)
    carry = np.zeros((grad.shape[1], h), np.float32)
    for t in range(len(kept) - 1, -1, -1):
        state, z, r, n, un = kept[t]
        g = carry + grad[t]
        live = mask[t][:, None]
        own = np.where(live, g, 0)
        dn = own * (1 - z) * (1 - n * n)
        dz = own * (state - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        d_up = np.concatenate([dz, dr, dn * r], 1)
        dx[t] = np.concatenate([dz, dr, dn], 1)
        du += state.T @ d_up
        carry = np.where(live, own * z + d_up @ u.T, g)
    return dx, du


def pool(p: dict, states: np.ndarray, mask: np.ndarray | None):
    """Attention weights [steps, windows], what they were made of, the pooled state and the logit."""
    inner = np.tanh(states @ p["a"])
    e = inner @ p["v"]
    if mask is not None:
        e = np.where(mask, e, -1e9)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tb,tbh->bh", w, states)
    return w, inner, pooled, pooled @ p["o"] + p["c"][0]


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of each window; the last one reaches the text's end."""
    n = np.maximum(1, -(-(counts - WINDOW) // STEP) + 1)
    text = np.repeat(np.arange(len(counts)), n)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    return text, start, np.minimum(WINDOW, counts[text] - start)


class Lookup(dict):
    """Word -> row of a table of projected inputs of both sides; row 0 is no word at all."""

    def __init__(self, net: BiGru, most: int = 120_000):
        super().__init__()
        self.net, self.most = net, most
        self.rows = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.used = 1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.rows, self.used = np.zeros((1024, 6 * HIDDEN), np.float32), 1
        new = list({w for w in words if w not in self})
        if new:
            at = {}
            for w in new:
                at.setdefault(core(w), len(at))
            known = list(at)
            for a in range(0, len(known), 4096):
                x = self.net.inputs(known[a : a + 4096])[0]
                rows = np.concatenate([x @ self.net.p["wf"] + self.net.p["bf"], x @ self.net.p["wb"] + self.net.p["bb"]], 1)
                end = self.used + a + len(rows)
                if end > len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros((max(end, len(self.rows)), 6 * HIDDEN), np.float32)])
                self.rows[self.used + a : end] = rows
            for w in new:
                self[w] = self.used + at[core(w)]
            self.used += len(known)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def raw_toxicity(texts: list[bytes], lookup: Lookup, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The largest logit over each text's windows, and the number of that window in the text."""
    p, h = lookup.net.p, HIDDEN
    words = [words_in(text) for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = lookup.numbers([w for own in words for w in own])
    flat = np.concatenate([flat, np.zeros(WINDOW, np.int64)])
    first = np.cumsum(counts) - counts
    text, start, size = windows_of(counts)
    logit = np.empty(len(text), np.float32)
    order = np.argsort(-size, kind="stable")
    for a in range(0, len(order), batch):
        own = order[a : a + batch]
        steps = max(1, int(size[own[0]]))
        place = (first[text[own]] + start[own])[None, :] + np.arange(steps)[:, None]
        mask = None if size[own[-1]] == steps else np.arange(steps)[:, None] < size[own][None, :]
        number = flat[place] if mask is None else np.where(mask, flat[place], 0)
        x = lookup.rows[number]
        forward, _ = run_side(x[:, :, : 3 * h], p["uf"], mask, False)
        backward, _ = run_side(x[::-1, :, 3 * h :], p["ub"], None if mask is None else mask[::-1], False)
        logit[own] = pool(p, np.concatenate([forward, backward[::-1]], 2), mask)[3]
    edge = np.searchsorted(text, np.arange(len(texts)))
    worst = np.maximum.reduceat(logit, edge) if len(texts) else np.zeros(0, np.float32)
    hit = np.flatnonzero(logit == worst[text])
    return worst.astype(np.float64), hit[np.searchsorted(text[hit], np.arange(len(texts)))] - edge


def toxicity_scores(texts: list[bytes], lookup: Lookup) -> np.ndarray:
    raw = raw_toxicity(texts, lookup)[0]
    return 1 / (1 + np.exp(-np.clip(lookup.net.curve[0] * raw + lookup.net.curve[1], -30, 30)))


def gradients(net: BiGru, table: tuple, number: np.ndarray, mask: np.ndarray, y: np.ndarray):
    """Mean cross-entropy of windows [steps, windows] of word numbers, and its gradients by name."""
    p, h = net.p, HIDDEN
    words, place = np.unique(number, return_inverse=True)
    place = place.reshape(number.shape)
    row, buckets, scale = (x[words] for x in table)
    factor = column_scale(scale, buckets.shape[1])
    chars = np.einsum("wgd,wg->wd", p["gram"][buckets], factor)
    x = np.concatenate([p["word"][row], chars], 1)
    xf, xb = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
    forward, kf = run_side(xf[place], p["uf"], mask, True)
    backward, kb = run_side(xb[place[::-1]], p["ub"], mask[::-1], True)
    states = np.concatenate([forward, backward[::-1]], 2)
    w, inner, pooled, logit = pool(p, states, mask)
    d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    g = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
    d_pooled = d[:, None] * p["o"][None, :]
    d_states = w[:, :, None] * d_pooled[None]
    d_w = np.einsum("bh,tbh->tb", d_pooled, states)
    d_e = w * (d_w - (w * d_w).sum(0))
    g["v"] = np.einsum("tb,tbh->h", d_e, inner)
    d_inner = d_e[:, :, None] * p["v"] * (1 - inner * inner)
    g["a"] = np.einsum("tbi,tbj->ij", states, d_inner)
    d_states += d_inner @ p["a"].T
    dxf, g["uf"] = back_side(d_states[:, :, :h], kf, p["uf"], mask)
    dxb, g["ub"] = back_side(d_states[::-1, :, h:], kb, p["ub"], mask[::-1])
    d_x = np.zeros((len(words), x.shape[1]), np.float32)
    for side, dx, at in (("f", dxf, place), ("b", dxb, place[::-1])):
        flat = dx.reshape(-1, 3 * h)
        by_word = np.zeros((len(words), 3 * h), np.float32)
        np.add.at(by_word, at.reshape(-1), flat)
        g[f"w{side}"], g[f"b{side}"] = x.T @ by_word, by_word.sum(0)
        d_x += by_word @ p[f"w{side}"].T
    g["word"], g["gram"] = (row, d_x[:, :WORD_DIM]), (buckets.reshape(-1), (d_x[:, None, WORD_DIM:] * factor[:, :, None]).reshape(-1, CHAR_DIM))
    loss = float((np.logaddexp(0, logit) - y * logit).mean())
    return loss, g


def train_toxicity(texts: list[bytes], labels: np.ndarray, rounds: int = 4, passes: int = 2, batch: int = 128, rate: float = 0.01, seed: int = 11) -> BiGru:
    rng = np.random.default_rng(seed)
    same: dict[bytes, bytes] = {}
    words = [[same.setdefault(c, c) for c in map(core, words_in(text))] for text in texts]
    in_docs: dict[bytes, list[int]] = {}
    for own, y in zip(words, labels.tolist(), strict=True):
        for w in set(own):
            in_docs.setdefault(w, [0, 0])[y] += 1
    all_words = list(in_docs)
    number_of = {w: i + 1 for i, w in enumerate(all_words)}
    net = BiGru.new({w: i + 1 for i, w in enumerate(x for x in all_words if sum(in_docs[x]) >= 3)}, seed)
    buckets, scale = gram_buckets([b"", *all_words])
    table = (np.array([0, *(net.vocabulary.get(w, 0) for w in all_words)]), buckets, scale)
    # Log-odds by document of words and n-grams: the first choice of windows, and the first value of one input.
    seen = np.array([[0, 0], *(in_docs[w] for w in all_words)], np.float64)
    share = np.maximum(np.bincount(labels, minlength=2), 1)
    odds = lambda n: np.log((n[:, 1] + 0.5) / (share[1] + 1)) - np.log((n[:, 0] + 0.5) / (share[0] + 1))
    by_gram = np.stack([np.bincount(buckets.reshape(-1), np.repeat(seen[:, y], buckets.shape[1]), BUCKETS + 1) for y in (0, 1)], 1)
    by_gram[BUCKETS] = 0
    gram_odds = np.clip(odds(by_gram), -3, 3) * np.minimum(1, by_gram.sum(1) / 8)
    gram_odds[BUCKETS] = 0
    word_odds = np.clip(odds(seen), -4, 4) * np.minimum(1, seen.sum(1) / 4)
    net.p["gram"][:, 0] += 0.3 * gram_odds
    rows = table[0][1:]
    net.p["word"][rows[rows > 0], 0] += 0.3 * word_odds[1:][rows > 0]
    net.p["gram"][BUCKETS] = 0
    evidence = word_odds + np.where(buckets < BUCKETS, gram_odds[buckets], -9).max(1)
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.array([number_of[w] for own in words for w in own] + [0] * WINDOW, np.int64)
    first = np.cumsum(counts) - counts
    text, start, size = windows_of(counts)
    edge = np.searchsorted(text, np.arange(len(texts)))
    n_windows = np.bincount(text, minlength=len(texts))
    steps = np.arange(WINDOW)[:, None]

    def numbers(own):
        mask = steps < size[own][None, :]
        return np.where(mask, flat[np.minimum((first[text[own]] + start[own])[None, :] + steps, len(flat) - 1)], 0), mask

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        if turn == 0:
            value = np.concatenate([evidence[numbers(np.arange(a, min(a + 4096, len(text))))[0]].max(0) for a in range(0, len(text), 4096)])
            worst = np.array([np.argmax(value[edge[i] : edge[i] + n_windows[i]]) for i in range(len(texts))])
        else:
            lookup = Lookup(net)
            worst = np.concatenate([raw_toxicity(texts[a:b], lookup)[1] for a, b in slices(texts)])
        clean = np.flatnonzero(labels == 0)
        chosen = np.concatenate([edge + worst, *((edge[clean] + rng.integers(0, n_windows[clean])) for _ in range(2))])
        y = np.concatenate([labels, np.zeros(2 * len(clean), np.int64)]).astype(np.float32)
        for _ in range(passes):
            order = rng.permutation(len(chosen))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                _, g = gradients(net, table, *numbers(chosen[own]), y[own])
                step += 1
                for k, slope in g.items():
                    m, v = moments[k]
                    if k in ("word", "gram"):
                        at, back = np.unique(slope[0], return_inverse=True)
                        total = np.zeros((len(at), slope[1].shape[1]), np.float32)
                        np.add.at(total, back, slope[1])
                        m[at] += 0.1 * (total - m[at])
                        v[at] += 0.01 * (total**2 - v[at])
                        net.p[k][at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)
                    else:
                        m += 0.1 * (slope - m)
                        v += 0.01 * (slope**2 - v)
                        net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                net.p["gram"][BUCKETS] = 0
    lookup = Lookup(net)
    raw = np.concatenate([raw_toxicity(texts[a:b], lookup)[0] for a, b in slices(texts)])
    net.curve = fit_curve(raw, labels)
    return net


def learn_toxicity(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, keep: Column, most: int = 900, most_bytes: int = 64 << 20) -> BiGru:
    """``keep`` is a condition on the id, called k; at most ``most`` documents of each label are read, and about ``most_bytes`` of text."""
    marks = agreed_labels(labels, key, label, keep)
    some = [marks.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most) for y in (0, 1)]
    texts, marked = learning_sample(docs, some[0].union(some[1]), key, text, 2 * most, most_bytes)
    if len(set(marked.tolist())) < 2:  # nothing to tell apart: every text gets the same score
        net = BiGru.new({})
        share = float(np.clip(marked.mean() if len(marked) else 0.05, 0.05, 0.95))
        net.p["o"][:] = 0
        net.curve = (1.0, float(np.log(share / (1 - share))))
        return net
    return train_toxicity(texts, marked)


def score_toxicity(docs: DataFrame, text: str, net: BiGru, keys: list[str], name: str = "score") -> DataFrame:
    """The columns ``keys`` and the toxicity of each text, read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    bounded_batches(docs.sparkSession)
    own = keys if text in keys else [*keys, text]  # a text among the columns kept is not sent twice
    rows = docs.select(*[(F.col(c).cast("string") if c == text else F.col(c)).alias(f"k{i}") for i, c in enumerate(own)])
    at, schema = own.index(text), T.StructType([*rows.schema.fields[: len(keys)], T.StructField("score", T.DoubleType())])

    def score(batches):
        lookup = Lookup(shared.value)
        for batch in batches:
            texts = bytes_of(batch.column(at))
            values = np.empty(len(texts))
            for a, b in slices(texts, 2 << 20):
                values[a:b] = toxicity_scores(texts[a:b], lookup)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(values)], names=[*(f"k{i}" for i in range(len(keys))), "score"])

    scored = rows.mapInArrow(thrifty(score), schema)
    return scored.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("score").alias(name))
