"""Scoring of texts by a gated recurrent language model, beside a smoothed unigram base.

Tokens are words and one end for each text. Counts cover every learning text. The model factors
a token's probability: classes given the state, then words given class and state. The most
frequent tokens are listed: LISTED_ROOT * sqrt(N) of N learning tokens, so the list grows with the
corpus. Their classes are runs of the frequency order with equal sums of root counts, about
CLASS_ROOT * sqrt(listed) of them, so that frequent words lie in small classes. Every other word
lies in one of SHAPES open classes told by its last sign and non-ASCII letters, and is drawn from
that class by its count plus a half, with one place for all unknown words. So the distribution
sums to one.

All weights learn by truncated backpropagation in numpy from every learning text, read whole once:
the texts are dealt by hash into ROUNDS parts, and in each round some tasks, the learners, each train
on their share of the part, from the same weights. Their changes are averaged in Spark, those of a
word's row by how often the learner met the word or its class. A learner has at least PER_WEIGHT
tokens for each weight, so what the learners send stays below the texts in size. The biases start
from all counts. Once words are counted, texts are cut into tokens a last time, and these are written
for learners and scores to read; more than 2 GB of tokens of one text raise. Scoring reads whole texts: windows of steps, the state carried from each to the next.

What is broadcast is bounded by proof: a word whose count is at least N / PLACES can be one of at
most PLACES. Every other word's count is joined. Null and empty texts are one end. A very long text
is read by one task, step by step, in memory that does not grow with it beyond its tokens. Repeated
rows are counted and scored each for itself. A null id belongs to no fold: its text is counted and scored.
Only the two named columns are read, whatever others are called. Words of equal count are listed in the order of their hashes.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.llm.common import MIX, binary_list, bounded_batches, mixed, saved, slices, text_bytes, thrifty, together

PLACES = 2_000_000
LISTED_ROOT, CLASS_ROOT = 1.0, 0.75
HIDDEN, INPUT = 16, 16
#: Steps of a full group of texts between two looks at the outputs when scoring, and steps of truncated backpropagation.
WINDOW, UNROLL = 32, 16
#: Rows whose outputs are worked out at a time: those stay in a core's cache, which tasks on other cores do not share.
CACHED = 512
ROUNDS, PER_WEIGHT = 3, 8
#: Output weights stay within this, so that exp of HIDDEN of them and a bias neither overflows nor needs a maximum taken off.
REACH = 4.0
#: Rows of float weights sent at a time.
BLOCK = 4096
#: Bytes of text, and tokens, that a task works on at once.
SLICE, LESSON = 12 << 20, 2 << 20
#: Groups of last signs that tell the open classes.
ENDINGS = (b"e", b"s", b"n", b"r", b"t", b"d", b"y", b"l", b"a", b"i", b"o", b".", b",", b"!", b"0123456789")
SHAPES = 2 * (len(ENDINGS) + 1)
#: Bytes whose words are hashed in one step, and words that are looked up in one: their arrays stay in a core's cache.
STRIDE, LOOKED_UP = 1 << 15, 1 << 15
#: Bytes of the longest word that is hashed by eights.
LONG = 64
#: Masks of the first 0 to 8 bytes, and of their high bits.
KEPT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
BEYOND_ASCII = np.uint64(0x8080808080808080)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SHAPE = np.zeros(256, np.int64)
for _i, _signs in enumerate(ENDINGS):
    SHAPE[list(_signs)] = 2 * _i + 2
SHAPE = SHAPE[LOWER]
_random = np.random.default_rng(71)
VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
BASE = int(_random.integers(1 << 62, 1 << 63)) | 1


def powers(base: int) -> np.ndarray:
    out = np.full(STRIDE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER, BACK = powers(BASE), powers(pow(BASE, -1, 1 << 64))
#: The end of a text.
END = 0


def eight_bytes(whole: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first eight bytes, or fewer, from each start on, out of little-endian words of eight."""
    at, bits = start >> 3, ((start & 7) << 3).astype(np.uint64)
    return (whole[at] >> bits | whole[at + 1] << (np.uint64(63) - bits) << np.uint64(1)) & KEPT[np.minimum(length, 8)]


def short_hashes(whole: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words read eight bytes at a time, and whether a byte is beyond ASCII; those of more than LONG bytes are not read to their end."""
    out, other = np.empty(len(start), np.uint64), np.empty(len(start), bool)
    for a in range(0, len(start), LOOKED_UP):
        s, n = start[a : a + LOOKED_UP], length[a : a + LOOKED_UP]
        x = eight_bytes(whole, s, n)
        high = x & BEYOND_ASCII
        h = mixed(x + n.astype(np.uint64) * MIX)
        for c in range(8, LONG, 8):
            more = np.flatnonzero(n > c)
            if not len(more):
                break
            x = eight_bytes(whole, s[more] + c, n[more] - c)
            high[more] |= x & BEYOND_ASCII
            h[more] = mixed((h[more] ^ x) * MIX)
        out[a : a + LOOKED_UP], other[a : a + LOOKED_UP] = h, high != 0
    return out, other


def long_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A polynomial in random values of its lower-cased bytes for each word raw[start:stop], then mixed."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        last = max(at + 1, int(np.searchsorted(stop, start[at] + STRIDE, "right")))
        a, b = int(start[at]), int(stop[last - 1])
        if b - a <= STRIDE:
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(VALUE[raw[a:b]] * POWER[: b - a], out=total[1:])
            s, e = start[at:last] - a, stop[at:last] - a
            out[at:last] = (total[e] - total[s]) * BACK[s]
        else:  # one word longer than a step: the sum of its steps
            steps = range(a, b, STRIDE)
            sums = np.array([(VALUE[raw[c : min(c + STRIDE, b)]] * POWER[: min(STRIDE, b - c)]).sum(dtype=np.uint64) for c in steps], np.uint64)
            out[at] = (sums * np.array([pow(BASE, c - a, 1 << 64) for c in steps], np.uint64)).sum(dtype=np.uint64)
        at = last
    return mixed(out + (stop - start).astype(np.uint64))


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, an end after each text's words, and the tokens of each text.

    A word's key is a 63-bit hash whose low five bits are its shape.
    """
    joined = b"\n".join([b"", *texts]).lower()  # ASCII letters alone
    joined += b"\n" * (16 - len(joined) % 8)
    raw = np.frombuffer(joined, np.uint8)
    space = (raw == 0x20) | (raw - np.uint8(0x09) < 5)
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, stop = turns[::2], turns[1::2]
    edge = np.cumsum([1, *(len(t) + 1 for t in texts)])
    words = np.diff(np.searchsorted(start, edge))
    keys = np.full(len(start) + len(texts), END, np.int64)
    if len(start):
        length = stop - start
        hashes, other = short_hashes(raw.view("<u8"), start, length)
        long = np.flatnonzero(length > LONG)
        if len(long):
            hashes[long] = long_hashes(raw, start[long], stop[long])
            other[long] = np.maximum.reduceat(raw, start)[long] >= 0x80
        inner = np.ones(len(keys), bool)
        inner[np.cumsum(words + 1) - 1] = False
        keys[inner] = (hashes >> np.uint64(6)).astype(np.int64) << 5 | SHAPE[raw[stop - 1]] | other
    return keys, words + 1


def word_key(word: bytes) -> int:
    return int(token_keys([word])[0][0])


def token_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(key, c) of all tokens of the texts ``t``; each task adds up what it holds before the shuffle."""

    def count(batches):
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            texts = binary_list(batch.column(0))
            for a, b in slices(texts, SLICE):
                new, met = np.unique(token_keys(texts[a:b])[0], return_counts=True)
                keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, met]), len(keys)).astype(np.int64)
                if len(keys) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
                    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return docs.select("t").mapInArrow(thrifty(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Tokens with counts of at least ``least``, by key; ``listed[i]`` is a token's rank among the listed or -1.

    ``edges`` are the ranks at which classes begin, and the number of listed tokens.
    """

    total: int
    distinct: int
    least: int
    keys: np.ndarray
    counts: np.ndarray
    listed: np.ndarray
    edges: np.ndarray
    open_mass: np.ndarray

    @property
    def n_listed(self) -> int:
        return int(self.edges[-1])

    @property
    def kind(self) -> type:
        """What holds a token."""
        return np.uint16 if self.n_listed + SHAPES <= 1 << 16 else np.int32

    @property
    def end(self) -> int:
        """The token of a text's end."""
        return int(self.tokens(np.array([END]))[1][0])

    @staticmethod
    def of(counts: DataFrame) -> Vocabulary:
        shape = F.col("key").bitwiseAND(31)
        by_shape = {r.s: (r.n, r.v) for r in counts.groupBy(shape.alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # SHAPES rows at most
        total, distinct = (sum(x[i] for x in by_shape.values()) for i in (0, 1))
        least = max(1, -(-total // PLACES))
        top = counts.where(F.col("c") >= least).toArrow().sort_by("key")  # PLACES rows at most
        keys, c = top["key"].to_numpy(), top["c"].to_numpy()
        order = np.lexsort((keys, -c))[: int(np.ceil(LISTED_ROOT * np.sqrt(total)))]
        listed = np.full(len(keys), -1, np.int32)
        listed[order] = np.arange(len(order))
        mass = np.empty(SHAPES)
        for s in range(SHAPES):
            own = order[(keys[order] & 31) == s]
            n, v = by_shape.get(s, (0, 0))
            mass[s] = (n - int(c[own].sum())) + 0.5 * (v - len(own) + 1)
        return Vocabulary(total, distinct, least, keys, c, listed, class_edges(c[order]), mass)

    @functools.cached_property
    def drawers(self) -> tuple[int, np.ndarray]:
        """Keys are hashes: cut by their first bits they lie evenly in about as many drawers; bits cut off, and where each drawer begins."""
        shift = 63 - max(len(self.keys), 1).bit_length()
        return shift, np.searchsorted(self.keys >> shift, np.arange((1 << 63 - shift) + 1)).astype(np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("drawers", "frequent")}  # made again where they are used

    @functools.cached_property
    def frequent(self) -> tuple[Vocabulary, np.ndarray]:
        """The listed tokens alone, among which a look-up stays in a core's cache, and their places among the kept keys."""
        own = np.flatnonzero(self.listed >= 0)
        return replace(self, keys=self.keys[own], counts=self.counts[own], listed=self.listed[own]), own.astype(np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each among the kept keys or -1. A look into a drawer misses a core's cache once, halving among all kept keys many times."""
        shift, begins = self.drawers
        place = np.full(len(keys), -1, np.int32)
        for a in range(0, len(keys), LOOKED_UP):
            wanted = keys[a : a + LOOKED_UP]
            at, stop = begins[wanted >> shift], begins[(wanted >> shift) + 1]
            open_ = np.flatnonzero(at < stop)
            at, stop, wanted = at[open_], stop[open_], wanted[open_]
            while len(open_):
                hit = self.keys[at] == wanted
                place[a + open_[hit]] = at[hit]
                at += 1
                more = ~hit & (at < stop)
                open_, at, stop, wanted = open_[more], at[more], stop[more], wanted[more]
        return place

    def tokens(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the kept keys or -1, and the model's token: the rank, or n_listed + shape."""
        open_ = (self.n_listed + (keys & 31)).astype(np.int32)
        if not self.n_listed:
            return self.places(keys), open_
        listed, own = self.frequent if len(self.keys) > self.n_listed else (self, None)
        at = listed.places(keys)
        found = at >= 0
        token = np.where(found, listed.listed[at], open_)
        if own is not None:
            rest = np.flatnonzero(~found)
            at = own[at]
            at[rest] = self.places(keys[rest])
        return at, token


def class_edges(counts: np.ndarray) -> np.ndarray:
    """Edges of classes with about equal sums of root counts over a falling order."""
    n = int(np.ceil(CLASS_ROOT * np.sqrt(len(counts))))
    reached = np.cumsum(np.sqrt(counts))
    inner = np.searchsorted(reached, np.arange(1, n) / n * reached[-1]) if n else np.zeros(0, np.int64)
    return np.unique(np.concatenate(([0], inner, [len(counts)])))


def new_weights(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Biases hold the log counts of all learning texts, so the model starts as a unigram model."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    used = np.flatnonzero(vocabulary.listed >= 0)
    c = np.zeros(vocabulary.n_listed)
    c[vocabulary.listed[used]] = vocabulary.counts[used]
    classes = len(vocabulary.edges) - 1
    mass = np.concatenate([np.add.reduceat(c, vocabulary.edges[:-1]) if classes else np.zeros(0), vocabulary.open_mass])
    word = np.log(c) - np.log(np.repeat(mass[:classes], np.diff(vocabulary.edges)))
    return {
        "e": draw(len(c) + SHAPES, INPUT, scale=0.3), "w": draw(INPUT, 3 * HIDDEN, scale=INPUT**-0.5), "u": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "b": np.zeros(3 * HIDDEN, np.float32),
        "wc": draw(HIDDEN, classes + SHAPES, scale=0.05), "bc": np.log(mass / mass.sum()).astype(np.float32), "ww": draw(len(c), HIDDEN, scale=0.05), "bw": word.astype(np.float32),
    }


#: Weights that have a row for each token; the rest are dense and small.
ROWS = ("e", "ww", "bw")


def halved(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of each token and recurrent weights, those of the gates halved: sigmoid(x) = tanh(x / 2) / 2 + 1 / 2."""
    table, u = p["e"] @ p["w"] + p["b"], p["u"].copy()
    table[:, : 2 * HIDDEN] *= 0.5
    u[:, : 2 * HIDDEN] *= 0.5
    return table, u


def squashed(x: np.ndarray) -> np.ndarray:
    """tanh in place; numpy's exp takes half the time of its tanh, and an exp that overflows gives one."""
    x *= 2
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def step(x: np.ndarray, state: np.ndarray, u: np.ndarray):
    """The next state, both gates, the candidate and its recurrent part.

    Fast where x and state lie feature by feature, as transposed arrays: then each gate is a whole run of memory, and so is what comes back.
    """
    up = (u.T @ state.T).T
    gate = squashed(x[:, : 2 * HIDDEN] + up[:, : 2 * HIDDEN])
    gate *= 0.5
    gate += 0.5
    n = gate[:, HIDDEN:] * up[:, 2 * HIDDEN :]
    n += x[:, 2 * HIDDEN :]
    new = state - squashed(n)
    new *= gate[:, :HIDDEN]
    new += n
    return new, gate, n, up[:, 2 * HIDDEN :]


def class_table(edges: np.ndarray) -> np.ndarray:
    """The class of each token, open ones after those of the listed."""
    classes = len(edges) - 1
    return np.concatenate([np.repeat(np.arange(classes), np.diff(edges)), classes + np.arange(SHAPES)]).astype(np.int16 if classes + SHAPES < 1 << 15 else np.int32)


def with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.concatenate([weights, bias[None]]))


def log_probabilities(p: dict, edges: np.ndarray, states: np.ndarray, token: np.ndarray, most: int = CACHED) -> np.ndarray:
    """Natural log probability of each listed token, or of its open class, after each state; all logits lie far below 88."""
    own = class_table(edges)[token]
    h, ones = np.ones((len(states), HIDDEN + 1), np.float32), np.ones(max(p["wc"].shape[1], int(np.diff(edges).max(initial=0))), np.float32)
    order = np.argsort(own, kind="stable")
    h[:, :HIDDEN] = np.take(states.T, order, axis=1).T
    own, token = own[order], token[order]
    value, weights = np.empty(len(token)), with_bias(p["wc"], p["bc"])
    for a in range(0, len(token), most):
        logit = h[a : a + most] @ weights
        hit = logit[np.arange(len(logit)), own[a : a + most]]
        np.exp(logit, out=logit)
        value[a : a + most] = hit - np.log(logit @ ones[: logit.shape[1]])
    edge = np.searchsorted(own, np.arange(len(edges)))
    for c in np.flatnonzero(np.diff(edge)):
        words = slice(edges[c], edges[c + 1])
        weights = with_bias(p["ww"][words].T, p["bw"][words])
        for a in range(edge[c], edge[c + 1], most):
            rows = slice(a, min(a + most, edge[c + 1]))
            logit = h[rows] @ weights
            hit = logit[np.arange(len(logit)), token[rows] - edges[c]]
            np.exp(logit, out=logit)
            value[rows] += hit - np.log(logit @ ones[: logit.shape[1]])
    out = np.empty(len(value))
    out[order] = value
    return out


@np.errstate(over="ignore")
def text_log_likelihood(p: dict, edges: np.ndarray, tokens: np.ndarray, counts: np.ndarray, end: int, together: int = 2048) -> np.ndarray:
    """Sum of log_probabilities over each text; texts of like length advance together, and a look at the outputs takes as many tokens however few they are."""
    table, u = halved(p)
    order = np.argsort(-counts, kind="stable")
    n, first = counts[order], (np.cumsum(counts) - counts)[order]
    total = np.zeros(len(counts))
    for s in range(0, len(order), together):
        falling, at = -n[s : s + together], first[s : s + together]
        state = np.zeros((HIDDEN, len(at)), np.float32).T
        states = np.empty((HIDDEN, min(int(-falling.sum()), (WINDOW + 1) * together)), np.float32)
        before = np.full(len(at), end)
        longest = -int(falling[0])
        left = np.searchsorted(falling, -np.arange(longest), "left").tolist()
        targets, alive, waiting = [], [], 0
        for t, k in enumerate(left):
            state = step(np.ascontiguousarray(table[before[:k]].T).T, state[:k], u)[0]
            before = tokens[at[:k] + t]
            states[:, waiting : waiting + k] = state.T
            targets.append(before)
            alive.append(k)
            waiting += k
            if waiting >= WINDOW * together or t == longest - 1:  # few long texts go on for many steps
                value = log_probabilities(p, edges, states[:, :waiting].T, np.concatenate(targets))
                text = np.arange(waiting) - np.repeat(np.cumsum(alive) - alive, alive)
                total[s : s + alive[0]] += np.bincount(text, value, alive[0])
                targets, alive, waiting = [], [], 0
    out = np.empty(len(counts))
    out[order] = total
    return out


class Trainer:
    """Weights that learn from tokens: Adam for the dense ones, Adagrad by row for those of a token."""

    def __init__(self, p: dict[str, np.ndarray], edges: np.ndarray, end: int, rate: float = 0.02):
        self.p, self.edges, self.end, self.rate = {k: x.copy() for k, x in p.items()}, edges, end, rate
        self.out = with_bias(p["ww"].T, p["bw"])  # words' weights and biases, one below the other
        self.p["ww"], self.p["bw"] = self.out[:HIDDEN].T, self.out[HIDDEN]
        self.first, self.class_of = p, class_table(edges)
        self.dense = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items() if k not in ROWS}
        self.rows = {k: np.full(len(p[k]), 1e-6, np.float32) for k in ROWS}
        self.met = {"e": np.zeros(len(p["e"])), "class": np.zeros(len(edges) - 1)}
        self.mean, self.ones = np.full(HIDDEN, 1 / HIDDEN, np.float32), np.ones(int(np.diff(edges).max(initial=0)), np.float32)
        self.places = np.arange(512 * UNROLL)
        self.small = np.uint16 if len(p["e"]) <= 1 << 16 else np.int32  # sixteen bits are sorted in linear time
        self.count, self.tokens = 0, 0

    def learn(self, tokens: np.ndarray) -> None:
        """Reads the tokens as parallel streams; the state is carried over windows and cleared after an end."""
        streams = max(1, min(512, max(len(tokens) // (UNROLL * 200), min(8, len(tokens) // UNROLL))))
        steps = len(tokens) // streams // UNROLL * UNROLL
        if steps:
            stream = np.ascontiguousarray(tokens[: steps * streams].reshape(streams, steps).T)
            inputs = np.concatenate([np.full((1, streams), self.end, stream.dtype), stream[:-1]])
            state = np.zeros((streams, HIDDEN), np.float32)
            for a in range(0, steps, UNROLL):
                state = self._window(inputs[a : a + UNROLL], stream[a : a + UNROLL], state)
        rest = tokens[steps * streams :]  # what does not fill a window of every stream
        if len(rest) >= UNROLL:
            self.learn(rest)
        elif len(rest):
            self._window(np.concatenate([[self.end], rest[:-1]])[:, None], rest[:, None], np.zeros((1, HIDDEN), np.float32))

    @np.errstate(over="ignore")
    def _window(self, x: np.ndarray, y: np.ndarray, state: np.ndarray) -> np.ndarray:
        """One step of descent. What the recurrence works on lies feature by feature, each feature step by step."""
        p, edges, h2, (steps, streams) = self.p, self.edges, 2 * HIDDEN, x.shape
        token, x = y.reshape(-1), x.reshape(-1)
        inputs = p["e"][x]
        w, b, u = p["w"].copy(), p["b"].copy(), p["u"].copy()
        for half in (w[:, :h2], b[:h2], u[:, :h2]):
            half *= 0.5
        projected = w.T @ inputs.T
        projected += b[:, None]
        projected = projected.reshape(-1, steps, streams)
        live = (x != self.end).astype(np.float32).reshape(steps, 1, streams)
        (states, starts), kept = np.empty((2, HIDDEN, steps, streams), projected.dtype), []
        for t in range(steps):
            start = np.multiply(state.T, live[t], out=starts[:, t]).T
            state, gate, n, un = step(projected[:, t].T, start, u)
            states[:, t] = state.T
            kept.append((gate[:, :HIDDEN].T, gate[:, HIDDEN:].T, n.T, un.T))
        own = self.class_of[token]
        share = np.float32(1 / len(token))
        order = np.argsort(own, kind="stable")
        with_one = np.ones((len(token), HIDDEN + 1), states.dtype)
        with_one[:, :HIDDEN] = np.take(states.reshape(HIDDEN, -1), order, axis=1).T
        token, own = token[order], own[order]
        weights, back_weights = with_bias(p["wc"], p["bc"]), np.ascontiguousarray(p["wc"].T)
        outer, dh, ones = np.zeros_like(weights.T), np.empty((len(token), HIDDEN), states.dtype), np.ones(weights.shape[1], np.float32)
        for a in range(0, len(token), CACHED):
            h = with_one[a : a + CACHED]
            d = h @ weights
            np.exp(d, out=d)
            total = d @ ones
            d[self.places[: len(h)], own[a : a + CACHED]] -= total
            scale = (share / total)[:, None]  # brings exp to slopes; put on the narrow side of both products
            outer += d.T @ (h * scale)
            np.multiply(d @ back_weights, scale, out=dh[a : a + CACHED])
        slopes = {"wc": np.ascontiguousarray(outer[:, :HIDDEN].T), "bc": outer[:, HIDDEN]}
        edge = np.searchsorted(own, np.arange(len(edges)))
        within = token[: edge[-1]] - edges[own[: edge[-1]]]
        outer = np.zeros_like(self.out)
        for c in np.flatnonzero(np.diff(edge)):
            part, words = slice(edge[c], edge[c + 1]), slice(edges[c], edges[c + 1])
            h, weights = with_one[part], self.out[:, words]
            d = h @ weights
            np.exp(d, out=d)
            total = d @ self.ones[: d.shape[1]]
            d[self.places[: len(h)], within[part]] -= total
            scale = (share / total)[:, None]
            dh[part] += (d @ weights[:HIDDEN].T) * scale
            outer[:, words] = (h * scale).T @ d
        self.met["class"] += np.diff(edge)
        for a in range(0, int(edges[-1]), BLOCK):
            rows = slice(a, min(a + BLOCK, int(edges[-1])))
            self._row_step("ww", rows, outer[:HIDDEN, rows].T)
            self._row_step("bw", rows, outer[HIDDEN, rows])
        by_place = np.empty_like(dh)
        by_place[order] = dh
        dh = np.ascontiguousarray(by_place.T).reshape(HIDDEN, steps, streams)
        ups, downs, carry = np.empty((3 * HIDDEN, steps, streams), dh.dtype), np.empty_like(dh), 0
        for t in range(steps - 1, -1, -1):
            z, r, n, un = kept[t]
            one = dh[:, t] + carry
            keep = one * z
            one -= keep
            ups[:HIDDEN, t] = (starts[:, t] - n) * one * z
            dn = np.multiply(one, 1 - n * n, out=downs[:, t])
            dr = np.multiply(dn, r, out=ups[h2:, t])
            ups[HIDDEN:h2, t] = dr * un * (1 - r)
            keep += p["u"] @ ups[:, t]
            carry = np.multiply(keep, live[t], out=keep)
        ups, downs = ups.reshape(3 * HIDDEN, -1), downs.reshape(HIDDEN, -1)  # slopes of what recurs; of what comes in the candidate's differ
        slopes["u"] = starts.reshape(HIDDEN, -1) @ ups.T
        slopes["w"] = np.concatenate([inputs.T @ ups[:h2].T, inputs.T @ downs.T], axis=1)
        slopes["b"] = np.concatenate([ups[:h2].sum(1), downs.sum(1)])
        back, kinds, met = self._kinds(x)
        of_input = p["w"][:, :h2] @ ups[:h2]
        of_input += p["w"][:, h2:] @ downs
        self._row_step("e", kinds, np.stack([np.bincount(back, row, len(kinds)) for row in of_input], axis=1).astype(np.float32))
        self.met["e"][kinds] += met
        self.count += 1
        self.tokens += len(token)
        norm = np.sqrt(sum(float((s * s).sum()) for s in slopes.values()))
        pace = self.rate * min(1.0, self.count / 20)
        for k, slope in slopes.items():
            m, v = self.dense[k]
            slope *= min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (slope - m)
            v += 0.005 * (slope * slope - v)
            p[k] -= pace * (m / (1 - 0.9**self.count)) / (np.sqrt(v / (1 - 0.995**self.count)) + 1e-7)
        np.clip(p["wc"], -REACH, REACH, out=p["wc"])
        return state

    def _kinds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each token among the different ones, these, and how often each came."""
        by = np.argsort(x.astype(self.small), kind="stable")
        ordered = x[by]
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        met = np.diff(begins, append=len(ordered))
        back = np.empty(len(by), np.int64)
        back[by] = np.repeat(np.arange(len(met)), met)
        return back, ordered[begins], met

    def _row_step(self, name: str, rows, slope: np.ndarray) -> None:
        """Adagrad with one sum of squares for each row; a slice of rows is changed where it lies."""
        square = slope * slope
        total, own = self.rows[name][rows], self.p[name][rows]
        total += square if square.ndim == 1 else square @ self.mean[: square.shape[1]]
        size = np.float32(2.5 * self.rate) / np.sqrt(total)
        own -= slope * (size if slope.ndim == 1 else size[:, None])
        if name != "e":
            np.maximum(own, -REACH * HIDDEN if name == "bw" else -REACH, out=own)
            np.minimum(own, REACH, out=own)
        if not isinstance(rows, slice):
            self.rows[name][rows], self.p[name][rows] = total, own

    def changes(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """By name: how far each row of weights has moved, and what that counts in the average."""
        by_word = np.repeat(self.met["class"], np.diff(self.edges))
        weight = {"e": self.met["e"], "ww": by_word, "bw": by_word}
        return {k: (x - self.first[k], weight.get(k, np.full(len(x), float(self.tokens)))) for k, x in self.p.items()}


def fit(docs: DataFrame, vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights from all texts ``t``, or from rows of encoded(): rounds of local training whose changes are averaged."""
    spark, p = docs.sparkSession, new_weights(vocabulary, seed)
    if not vocabulary.total:
        return p
    if "tokens" not in docs.columns:
        docs = encoded(docs.select(F.lit(None).cast("long").alias("k"), "t", F.lit(True).alias("lesson")), vocabulary)
    kind, end = vocabulary.kind, vocabulary.end
    weights = sum(x.size for x in p.values())
    learners = max(1, min(docs.rdd.getNumPartitions(), vocabulary.total // ROUNDS // (PER_WEIGHT * weights)))
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vocabulary.edges, p))

        def learn(batches, r=r, shared=shared):
            edges, p = shared.value
            trainer = Trainer(p, edges, end, rate=0.02 * 0.4**r)
            for batch in together(batches, LESSON * kind().itemsize):
                texts = binary_list(batch.column(0))
                for a, b in slices(texts, LESSON * kind().itemsize):
                    trainer.learn(np.frombuffer(b"".join(texts[a:b]), kind).astype(np.int32))
            for name, (moved, weight) in trainer.changes().items():
                for a in range(0, len(moved), BLOCK):
                    w = weight[a : a + BLOCK].astype(np.float32)
                    total = moved[a : a + BLOCK] * (w if moved.ndim == 1 else w[:, None])
                    yield pa.RecordBatch.from_pydict({"name": [name], "at": [a], "weight": [w.tobytes()], "total": [total.tobytes()]})

        def add(batches):
            found: dict[tuple, list] = {}
            for batch in batches:
                for name, at, weight, total in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    own = found.setdefault((name, at), [0.0, 0.0])
                    own[0] = own[0] + np.frombuffer(weight, np.float32).astype(np.float64)
                    own[1] = own[1] + np.frombuffer(total, np.float32).astype(np.float64)
            for (name, at), (weight, total) in found.items():
                moved = total / np.maximum(np.repeat(weight, len(total) // len(weight)), 1e-9)
                yield pa.RecordBatch.from_pydict({"name": [name], "at": [at], "moved": [moved.astype(np.float32).tobytes()]})

        moves = docs.where(F.col("turn") == r).select("tokens").coalesce(learners).mapInArrow(thrifty(learn), "name string, at long, weight binary, total binary")
        mean = saved(moves, "lm-moves").repartition("name", "at").mapInArrow(add, "name string, at long, moved binary")
        p = {k: x.copy() for k, x in p.items()}
        for row in mean.collect():  # one model
            moved = np.frombuffer(row.moved, np.float32)
            rows = p[row.name][row.at : row.at + BLOCK]
            rows += moved.reshape(rows.shape)
        shared.destroy()
    return p


def encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Of each row (k, t, lesson): doc_id, a number, lesson, the round that learns from it, its tokens as numbers of the vocabulary's kind, and what its score has beside the model's part.

    That is n_tokens, known, base and rest of the kept words, and the keys of all others.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches):
        from pyspark import TaskContext

        vocabulary = shared.value
        row = TaskContext.get().partitionId() << 36
        log_count = np.concatenate([np.log10(vocabulary.counts + 0.5), [0.0]])  # place -1 is rare: added by the join
        log_open = np.concatenate([np.zeros(vocabulary.n_listed), np.log10(vocabulary.open_mass)])
        for batch in together(batches, SLICE):
            texts = binary_list(batch.column(1))
            for a, b in slices(texts, SLICE):
                keys, n = token_keys(texts[a:b])
                place, token = vocabulary.tokens(keys)
                in_count, first = log_count[place], np.cumsum(n) - n
                rest = np.add.reduceat(np.where(token < vocabulary.n_listed, 0, in_count - log_open[token]), first)
                rare = place < 0
                left = np.add.reduceat(rare, first, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left))), pa.int32()), pa.array(keys[rare]))
                raw, size = pa.py_buffer(token.astype(vocabulary.kind)), np.dtype(vocabulary.kind).itemsize
                tokens = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.array(np.concatenate(([0], np.cumsum(n))) * size, pa.int32()).buffers()[1], raw])
                doc_id, lesson, turn = (batch.column(i).slice(a, b - a) for i in (0, 2, 3))
                columns = {"doc_id": doc_id, "row": row + np.arange(len(n)), "lesson": lesson, "turn": turn, "tokens": tokens, "n_tokens": n, "known": n - left, "base": np.add.reduceat(in_count, first), "rest": rest, "rare": lists}
                yield pa.RecordBatch.from_pydict({k: x if isinstance(x, pa.Array) else pa.array(x) for k, x in columns.items()})
                row += len(n)

    turn = F.pmod(F.xxhash64("t"), F.lit(ROUNDS)).cast("int").alias("turn")
    return rows.select("k", "t", "lesson", turn).mapInArrow(thrifty(encode), "doc_id long, row long, lesson boolean, turn int, tokens binary, n_tokens long, known long, base double, rest double, rare array<long>")


def score_texts(docs: DataFrame, key: str, text: str, learn: Column) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10).

    ``learn`` is a condition on the id, called k, that marks the learning texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), text_bytes(text).alias("t"))
    rows = rows.withColumn("lesson", F.coalesce(learn, F.lit(True)))
    counts = saved(token_counts(rows.where("lesson")), "token-counts")
    vocabulary = Vocabulary.of(counts)
    whole = saved(encoded(rows, vocabulary), "tokens")
    kind, end = vocabulary.kind, vocabulary.end
    shared = spark.sparkContext.broadcast((vocabulary.edges, fit(whole.where("lesson"), vocabulary)))

    def score(batches):
        edges, p = shared.value
        for batch in together(batches, LESSON * kind().itemsize):
            texts = binary_list(batch.column(6))
            for a, b in slices(texts, LESSON * kind().itemsize):
                doc_id, row, n, known, base, rest = (batch.column(i).slice(a, b - a) for i in range(6))
                tokens = np.frombuffer(b"".join(texts[a:b]), kind).astype(np.int32)
                model = text_log_likelihood(p, edges, tokens, n.to_numpy(), end) / np.log(10)
                yield pa.RecordBatch.from_arrays([doc_id, row, n, known, base, pa.array(model + rest.to_numpy())], names=["doc_id", "row", "n_tokens", "known", "base", "model"])

    scores = whole.select("doc_id", "row", "n_tokens", "known", "base", "rest", "tokens")
    part = saved(scores.mapInArrow(thrifty(score), "doc_id long, row long, n_tokens long, known long, base double, model double"), "scores")
    rare_counts = counts.where(F.col("c") < vocabulary.least).select("key", F.log10(F.col("c") + 0.5).alias("value"))
    met = whole.select("row", F.explode("rare").alias("key")).join(rare_counts, "key")
    met = met.groupBy("row").agg(F.sum("value").alias("value"), F.count("*").alias("met"))
    known = F.col("known") + F.coalesce("met", F.lit(0))
    rest = F.coalesce("value", F.lit(0.0)) + (F.col("n_tokens") - known) * float(np.log10(0.5))
    floor = float(np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1)))
    return part.join(met, "row", "left").select("doc_id", "n_tokens", known.cast("long").alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + rest - F.col("n_tokens") * floor).alias("base_score"), (F.col("model") + rest).alias("score"))
