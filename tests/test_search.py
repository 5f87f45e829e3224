"""Searches of many queries: blocks, pieces of a block's scores, equal scores, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from siltline.config import Search
from siltline.operators import search

SCHEMA = "id long, day string, v array<float>"


def test_pieces_of_scores_give_the_whole_ranking(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"2026-08-{i % 3 + 1:02d}", [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(400)]
    odd = [(900, "2026-08-01", None), (901, "2026-08-01", [0.5, None, 0.5, 0.5, 0.5, 0.5])]
    items = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("format_string('i%04d', id) AS key", "day", "v")
    queries = spark.createDataFrame(rows[:60], SCHEMA).selectExpr("id", "v")
    config = Search(min_score=0.1, limit=7)
    # no more than 64 scores at a time, in blocks of which some are smaller than the limit
    out = search.rank_each(items, queries, "v", "day", "key", "id", config, query_block=9, item_block=40, scores_at_once=64).collect()
    got = {}
    for r in sorted(out, key=lambda r: (int(r.id), r.place)):
        got.setdefault(int(r.id), []).append((r.key, r.day, r.score))
    want = {}
    for i, _, q in rows[:60]:
        scored = [(round(float(np.dot(q, v)), 6), day, f"i{k:04d}") for k, day, v in rows]
        best = sorted((s for s in scored if s[0] >= 0.1), key=lambda s: s[2])
        best = sorted(sorted(best, key=lambda s: s[1], reverse=True), key=lambda s: -s[0])[:7]
        if best:
            want[i] = [(k, day, s) for s, day, k in best]
    assert got == want


def test_other_lengths_are_an_error_and_floats_travel_as_floats(spark):
    items = spark.createDataFrame([(1, "d", [1.0, 0.0]), (2, "d", [1.0])], SCHEMA).selectExpr("CAST(id AS string) AS key", "day", "v")
    queries = spark.createDataFrame([(1, "d", [1.0, 0.0])], SCHEMA).selectExpr("id", "v")
    with pytest.raises(Exception, match="different lengths"):
        search.rank_each(items, queries, "v", "day", "key", "id").collect()
    plan = search.rank_each(items, queries, "v", "day", "key", "id")._jdf.queryExecution().analyzed().toString()
    assert "array<double>" not in plan
    wide = search.rank_each(items.where("key = '1'"), queries.selectExpr("id", "CAST(v AS array<double>) AS v"), "v", "day", "key", "id").collect()
    assert [(r.id, r.place, r.key, r.score) for r in wide] == [("1", 1, "1", 1.0)]
