"""The longest shared run of tokens against every run, and how long it takes."""

from __future__ import annotations

import random
import time

from siltline.functions.runs import longest_run


def every(own, hay):
    runs = {tuple(hay[i:j]) for i in range(len(hay)) for j in range(i + 1, len(hay) + 1)}
    return max((j - i for i in range(len(own)) for j in range(i + 1, len(own) + 1) if tuple(own[i:j]) in runs), default=0)


def test_against_every_run():
    rng = random.Random(4)
    for _ in range(3000):
        letters = "ab" if rng.random() < 0.5 else "abcd"
        own, hay = ([rng.choice(letters) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        assert longest_run(own, hay) == every(own, hay), (own, hay)


def test_long_pairs_take_less_than_a_second():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    source = [rng.choice(words) for _ in range(20_000)]
    for own, want in (([rng.choice(words) for _ in range(2000)] + source[7000:10_000], 3000), (["a"] * 5000, 0), (source[:5000], 5000)):
        began = time.process_time()
        got = longest_run(own, source)
        assert got >= want and (want == 0 or got <= want + 2) and time.process_time() - began < 1
    assert longest_run(["a"] * 5000, ["a"] * 20_000) == 5000
