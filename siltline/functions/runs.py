"""The longest run of tokens that two texts share, in time linear in both."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_run(own: list[str], hay: list[str]) -> int:
    """Length of the longest run of ``own`` that occurs in ``hay``: a suffix automaton of the first reads the second."""
    follow: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0

    def state(n: int, to: dict[str, int], back: int) -> int:
        follow.append(to)
        length.append(n)
        link.append(back)
        return len(follow) - 1

    for token in own:
        new, at = state(length[last] + 1, {}, 0), last
        while at >= 0 and token not in follow[at]:
            follow[at][token] = new
            at = link[at]
        if at >= 0:
            there = follow[at][token]
            if length[there] != length[at] + 1:  # the shorter runs that end there get a state of their own
                copy = state(length[at] + 1, dict(follow[there]), link[there])
                while at >= 0 and follow[at].get(token) == there:
                    follow[at][token] = copy
                    at = link[at]
                link[there] = there = copy
            link[new] = there
        last = new
    best = run = at = 0
    for token in hay:
        while at and token not in follow[at]:
            at = link[at]
            run = length[at]
        if token in follow[at]:
            at, run = follow[at][token], run + 1
            best = max(best, run)
    return best


def longest_common_run(summary: Column, source: Column, word: str) -> Column:
    """The same for two columns of texts, cut into tokens of the pattern ``word``; a null has no tokens."""

    @F.arrow_udf("int")
    def run(summaries: pa.Array, sources: pa.Array) -> pa.Array:
        found = re.compile(word).findall
        cut = lambda t: [w.lower().strip(".,") for w in found(t or "")]
        return pa.array([longest_run(cut(a), cut(b)) for a, b in zip(summaries.to_pylist(), sources.to_pylist(), strict=True)], pa.int32())

    return run(summary, source)
