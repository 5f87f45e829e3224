from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltline.llm.blocks import strangers
from siltline.llm.graph import components
from siltline.llm.minhash import near_duplicates
from siltline.llm.top_k import BASE, CoverTree, top_k
from siltline.llm.vector_dups import directions, near_vectors, projections_for, retained_for, strongest

from .conftest import prose


def find(links, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, find(links, sets)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = find(edges, {x for e in edges for x in e})
    assert got == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_awkward_rows(docs, awkward):
    out = near_duplicates(docs, "doc_id", "text").toPandas()
    sets, component = brute(awkward)
    assert len(out) == len(awkward)
    for r in out.dropna(subset=["doc_id"]).itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], r.doc_id == component[r.doc_id])
    nulls = out[out.doc_id.isna()].sort_values("n_shingles")
    assert nulls.component_id.isna().tolist() == [True, False] and nulls.kept.tolist() == [True, False]
    assert near_duplicates(docs.where("false"), "doc_id", "text").count() == 0


def test_ids_of_several_texts(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    low, high = sorted((a, b), key=lambda t: t.encode())
    rows = [(5, low), (5, high), (2, high), (7, low), (9, c), (5, None), (9, c)]
    out = near_duplicates(spark.createDataFrame([(i, t if t is not None else low) if i == 5 else (i, t) for i, t in rows], "doc_id long, text string"), "doc_id", "text").toPandas()
    got = sorted(set(zip(out.doc_id, out.component_id, out.kept, strict=True)))
    assert got == [(2, 2, True), (5, 5, True), (7, 5, False), (9, 9, True)] and len(out) == 7


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_at_the_threshold_and_shared_passages(spark, seed):
    """A template's many variants, some not near to one another; a passage that many texts share; exact copies."""
    rng = random.Random(seed)
    template, passage = prose(rng, 150).split(), prose(rng, 60)
    rows = []
    for i in range(150):
        own = list(template)
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, prose(rng, rng.randrange(20, 90)) + "\n" + passage) for i in range(100)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(40)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").toPandas()
    _, component = brute(rows)
    assert dict(zip(out.doc_id, out.component_id, strict=True)) == component


def test_isolated_pairs_of_a_text_and_itself_with_a_third_more(spark):
    rng = random.Random(8)
    rows = []
    for i in range(0, 3000, 2):
        words = [f"w{rng.randrange(10**9)}" for _ in range(404)]
        rows += [(i, " ".join(words[:304])), (i + 1, " ".join(words))]  # 300 shingles of 400
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").toPandas()
    assert sorted(out.n_shingles.unique()) == [300, 400] and (out.component_id == out.doc_id // 2 * 2).all()


def vectors(seed=0, n=300, d=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[100:160] = x[0] + 0.12 * rng.standard_normal((60, d))
    x[160:200] = x[1] * rng.uniform(0.5, 3, (40, 1)) + 0.2 * rng.standard_normal((40, d))
    x[200:230] = x[2]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * d), (902, [float("nan")] + [1.0] * (d - 1)), (903, [float("inf")] + [1.0] * (d - 1)), (904, [None] + [1.0] * (d - 1)), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (2, x[2].tolist())]
    return rows + odd, x


@pytest.mark.parametrize("light", [64, 6])
def test_near_vectors(spark, light):
    """Few members make a run of places heavy in the second case: it meets in blocks."""
    rows, x = vectors()
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, id int, x double")
    out = near_vectors(df, "vec_id", "embedding", light=light, block=64 if light == 64 else 10).toPandas()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    near[2:3, 200:230] = near[200:230, 2:3] = True
    links = [tuple(e) for e in np.argwhere(near)] + [(906, 907)]
    component = find(links, {i for i, _ in rows})
    count = {i: int(near[i].sum()) if i < len(x) else int(i in (906, 907)) for i, _ in rows}
    assert len(out) == len(rows)
    missed = sum(r.n_links != count[r.vec_id] for r in out.itertuples())
    assert missed <= 0.01 * len(out)  # recall at the very threshold is calibrated to 0.999
    assert dict(zip(out.vec_id, out.component_id, strict=True)) == component and (out.kept == (out.vec_id == out.component_id)).all()
    assert near_vectors(df.where("false"), "vec_id", "embedding").count() == 0


def test_vectors_of_one_id_count_once(spark):
    near = [[1.0, 0.1, 0.0], [1.0, 0.12, 0.0], [1.0, 0.14, 0.01]]
    rows = [(5, near[0]), (5, near[1]), (6, near[2]), (5, None), (None, near[0]), (7, [0.0, 0.0, 1.0])]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").toPandas()
    got = sorted((r.vec_id if r.vec_id == r.vec_id else -1, r.n_links, r.component_id if r.component_id == r.component_id else -1, r.kept) for r in out.itertuples())
    assert got == [(-1, 0, -1, True), (5, 0, 5, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]


def test_calibration_says_where_it_fails():
    assert retained_for(64, 0.95, 2048, 0.999) <= retained_for(64, 0.9, 2048, 0.999)
    with pytest.raises(ValueError, match="recall"):
        retained_for(64, 0.2, 2048, 0.999)


@pytest.mark.parametrize("blocks", [(2048, 4096, 8), (16, 32, 2)])
def test_top_k_is_exact(spark, blocks):
    rows, x = vectors(3)
    df = spark.createDataFrame([(i, v, "q", 7) for i, v in rows], "vec_id long, embedding array<float>, q string, c int")
    out = top_k(df, "vec_id", "embedding", F.col("id") % 10 == 0, 20, 64.0, *blocks).toPandas()
    whole = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64))) for i, v in rows if v is not None and all(a is not None and np.isfinite(a) for a in v)]
    want = []
    for q in sorted({i for i, _ in whole if i % 10 == 0}):
        own = next(v for i, v in whole if i == q)
        scores = sorted(((-int(own @ v), i) for i, v in whole if i != q and len(v) == len(own)))[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, out.itertuples(index=False))) == want
    assert top_k(df.where("false"), "vec_id", "embedding", F.col("id") % 10 == 0).count() == 0


def test_top_k_of_repeated_ids_and_large_components(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 3.0]), (1, [5.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 2.0]), (None, [9.0, 9.0]), (3, [-1.0, -2.5])]
    out = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") == 0, 3)
    assert [tuple(r) for r in out.orderBy("rank").collect()] == [(0, 1, 2, 64 * 128 + 128 * 128), (0, 2, 1, 64 * 320), (0, 3, 1, 64 * 32 + 128 * 32)]
    fits = [(0, [2.0**30, 1.0]), (1, [2.0**19, 3.0]), (2, [2.0**19, 2.0]), (3, [2.0**19, 3.0 + 2**-6])]
    out = top_k(spark.createDataFrame(fits, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") == 0, 3)
    assert [(r.vec_id, r.score) for r in out.orderBy("rank").collect()] == [(3, 2**61 + 64 * 193), (1, 2**61 + 64 * 192), (2, 2**61 + 64 * 128)]
    with pytest.raises(Exception, match="fit a long"):
        top_k(spark.createDataFrame([(0, [1e20, 0.0]), (1, [1e20, 0.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") == 0, 3).collect()


def test_cover_trees_cover_nest_and_separate():
    rng = np.random.default_rng(4)
    middles = rng.uniform(-100, 100, (40, 3))
    points = np.concatenate([middles[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 3)), np.zeros((50, 3))])
    tree = CoverTree(points, 16)
    assert (tree.child[:, 1] > 0).sum() > 20 and sorted(tree.order) == list(range(len(points)))
    for node, ((a, b), (first, n)) in enumerate(zip(tree.span, tree.child, strict=True)):
        far = np.sqrt(((tree.points[a:b] - tree.centre[node]) ** 2).sum(1))
        assert far.max() <= tree.radius[node] + 1e-9 and (tree.radius[node] == 0 or tree.radius[node] <= BASE ** tree.level[node] * (1 + 1e-6))
        if n:
            own = tree.centre[first : first + n]
            gaps = np.sqrt(((own[:, None] - own[None]) ** 2).sum(2)) + np.eye(n) * 1e9
            assert gaps.min() > BASE ** (tree.level[node] - 1) and (own == tree.centre[node]).all(1).any()
            assert (tree.radius[first : first + n] <= BASE ** (tree.level[node] - 1) * (1 + 1e-9)).all()
            assert [tuple(x) for x in tree.span[first : first + n]][0][0] == a and tree.span[first + n - 1][1] == b


def test_far_blocks_are_not_met(spark, monkeypatch):
    """Groups far apart: after the first meeting no other pair of blocks can hold an answer."""
    from siltline.llm import top_k as module

    rng = np.random.default_rng(8)
    middles = np.eye(6) * 1000
    rows = [(i, (middles[i % 6] + rng.standard_normal(6)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept, real = {}, module.saved
    monkeypatch.setattr(module, "saved", lambda table, name: kept.setdefault(name, []).append(real(table, name)) or kept[name][-1])
    out = top_k(df, "vec_id", "embedding", F.col("id") % 20 == 0, 5, 64.0, 50, 100, 2)
    got = sorted(tuple(r) for r in out.collect())
    x = np.floor(64 * np.array([v for _, v in rows]))
    want = []
    for q in range(0, 1200, 20):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(1200) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
    all_pairs = kept["query-table"][0].count() * kept["candidate-table"][0].count()
    assert sum(t.count() for t in kept["block-pairs"]) < all_pairs / 2


def test_chance_meetings_grow_as_the_vectors(spark):
    """Pairs of vectors that keep one pair of directions, before any window: five times the vectors, less than six times the pairs."""
    met = []
    for n in (10_000, 50_000):
        projections, rng = projections_for(n), np.random.default_rng(5)
        to, retained = directions(64, projections), retained_for(64, 0.95, projections, 0.999)
        runs = []
        for _ in range(n // 2_000):
            top, _ = strongest(rng.standard_normal((2_000, 64)) / 8, to, retained)
            runs += [top[:, a].astype(np.int64) * (2 * projections) + top[:, b] for a, b in itertools.combinations(range(retained), 2)]
        _, members = np.unique(np.concatenate(runs), return_counts=True)
        met.append(int((members * (members - 1) // 2).sum()))
    assert met[1] < 6 * met[0], met
    assert projections_for(0) == projections_for(10_000) == 2048 and projections_for(10**9) > 600_000


def test_many_projections_have_coarser_places(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base + 0.03 * rng.standard_normal(base.shape)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.triu(unit @ unit.T >= 0.95, 1).sum()
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = near_vectors(df, "vec_id", "embedding", projections=1 << 15).toPandas()
    assert out["n_links"].sum() == 2 * want > 0


def test_a_stranger_among_many_of_one_kind(spark):
    dealt = []
    for n in (4_000, 20_000):
        rows = spark.range(n).selectExpr("1L AS v", "id", "0L AS component").union(spark.createDataFrame([(1, n, n)], "v long, id long, component long"))
        met = strangers(rows, "v", "id", "component", 256)
        blocks = -(-n // 256)
        dealt.append(met.count())
        assert dealt[-1] == n + blocks + 1 and met.where(f"id = {n}").count() == blocks + 1  # its own block is dealt to itself
    assert dealt[1] < 6 * dealt[0]


def test_all_of_different_kinds_meet_once(spark):
    rng = random.Random(3)
    rows = [(v, i, rng.choice([0, 0, 0, 1, 1, i + 100])) for v in range(6) for i in range(rng.choice([1, 2, 30, 90]))]
    cells = {}
    for r in strangers(spark.createDataFrame(rows, "v long, id long, component long"), "v", "id", "component", 8).collect():
        cells.setdefault((r.v, r.left_block, r.right_block), []).append((r.block, r.id, r.component))
    met = Counter()
    for (v, left, right), own in cells.items():
        for (b, i, c), (d, j, e) in itertools.combinations(own, 2):
            if c != e and {b, d} == {left, right} and (b != d or left == right):
                met[v, min(i, j), max(i, j)] += 1
    want = {(v, min(i, j), max(i, j)) for (v, i, c), (w, j, e) in itertools.combinations(rows, 2) if v == w and c != e}
    assert set(met) == want and set(met.values()) == {1}
    assert max(map(len, cells.values())) <= 60


def test_rows_without_a_usable_vector_link_with_nothing(spark):
    rows = [(5, [1.0, 0.0]), (5, None), (6, [1.0, 0.001]), (5, [0.0, 0.0]), (7, [float("nan"), 1.0]), (3, [1.0, 0.0005])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect())
    assert got == [(3, 2, 3, True), (5, 0, 5, True), (5, 0, 5, True), (5, 2, 3, False), (6, 2, 3, False), (7, 0, 7, True)]
