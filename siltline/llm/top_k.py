"""Exact top-k by inner product: a dual-tree search over cover trees.

Queries and candidates are dealt into compact blocks: nearest of a few pivots, then by hash. Each
block is a cover tree. A table of blocks holds each one's pivot and radius. First every block of
queries meets one block of candidates of its own pivot, which gives each query a k-th score; then
only those pairs of blocks go on whose bound

    <q, c> <= <q0, c0> + |q0| rc + |c0| rq + rq rc

reaches the worst k-th score of the block of queries. Pairs of blocks meet in a grid of tasks, some
blocks of queries by some of candidates, so a block's tree is built once in a task for all the blocks
that it meets there. In a pair of trees, node pairs are expanded together and pruned by the same
bound against the worst k-th score of the node's queries; leaf pairs left over are scored, the most
promising first. Equal scores go to the smaller id.

Scores are exact integers: in doubles while no sum can reach 2**53, else in whole numbers of any size,
row by row; a score that does not fit a long is an error. Vectors take part if all their components are
finite numbers; lengths must agree for a score. Every row is a candidate, so repeated rows are answers
each; of the rows of a query's id the smallest vector, in the order of its components, asks, and it
does not meet rows of its own id. Rows without an id take no part. The pivots are a bounded sample: they shape blocks, not results.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltline.llm.blocks import cells
from siltline.llm.common import ragged, saved, thrifty
from siltline.llm.vector_dups import finite

LEAF, QUERY_LEAF, BASE, PIVOTS = 128, 256, 1.3, 32
#: Candidates that are scored in one step.
STEP = 1024


class CoverTree:
    """Points in tree order; leaves are ranges of them.

    A node of level l covers its points within BASE ** l of its centre. Its children are of level l - 1:
    their centres, of which the node's own is the first, lie more than BASE ** (l - 1) apart, and each
    point goes to the nearest. Nodes of few points are leaves, and so are those that would have a child
    for every few points, as in many dimensions: these are scored as they are. Radii are measured.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        centre, radius, span, child, level = [], [], [], [], []
        queue = [(0, len(points), self._centre(points))]
        while queue:
            a, b, c = queue.pop(0)
            own = points[self.order[a:b]]
            far = np.sqrt(((own - points[c]) ** 2).sum(1))
            node = len(centre)
            centre.append(c)
            radius.append(float(far.max()))
            span.append((a, b))
            child.append((0, 0))
            level.append(int(np.ceil(np.log(radius[node]) / np.log(BASE) - 1e-9)) if radius[node] > 0 else -(1 << 20))
            if b - a > leaf and radius[node] > 0:
                apart = BASE ** (level[node] - 1)
                heads, near, label = [int(np.argmin(far))], far.copy(), np.zeros(b - a, np.int64)
                while near.max() > apart and len(heads) <= (b - a) // 8:
                    heads.append(int(np.argmax(near)))
                    to = np.sqrt(((own - own[heads[-1]]) ** 2).sum(1))
                    label[to < near] = len(heads) - 1
                    near = np.minimum(near, to)
                if near.max() > apart:
                    continue
                by = np.argsort(label, kind="stable")
                head_points = self.order[a:b][heads]
                self.order[a:b] = self.order[a:b][by]
                edge = a + np.searchsorted(label[by], np.arange(len(heads) + 1))
                child[node] = (node + len(queue) + 1, len(heads))
                queue += [(int(x), int(y), int(h)) for x, y, h in zip(edge, edge[1:], head_points, strict=False)]
        self.points = points[self.order]
        self.centre, self.radius, self.span, self.child, self.level = points[centre], np.array(radius), np.array(span), np.array(child), np.array(level)
        self.norm = np.sqrt((self.centre**2).sum(1))
        self.largest = float(np.sqrt((points**2).sum(1)).max())

    @staticmethod
    def _centre(points: np.ndarray) -> int:
        return int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))


def bounds(a: CoverTree, i: np.ndarray, b: CoverTree, j: np.ndarray) -> np.ndarray:
    """No inner product of a point below node i of a with one below node j of b is larger."""
    inner = np.einsum("pd,pd->p", a.centre[i], b.centre[j])
    return inner + a.norm[i] * b.radius[j] + b.norm[j] * a.radius[i] + a.radius[i] * b.radius[j] + 1e-6 + 1e-12 * a.largest * b.largest


def exact_best(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, candidate_ids: np.ndarray, k: int):
    """(row, score, id) of each query's k best in whole numbers of any size."""
    whole = [list(map(int, c)) for c in candidates.tolist()]
    for row, q in enumerate(queries.tolist()):
        own = list(map(int, q))
        scored = ((sum(x * y for x, y in zip(own, c, strict=True)), -i) for c, i in zip(whole, candidate_ids.tolist(), strict=True) if i != query_ids[row])
        yield from ((row, score, -i) for score, i in heapq.nlargest(k, scored))


class Answers:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.best = k, np.full((n, k), -np.inf)
        self.query, self.score, self.id = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]

    def offer(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        q, c = np.nonzero(scores >= self.best[rows, -1][:, None])
        value = scores[q, c]
        q, c, value = q[value > -np.inf], c[value > -np.inf], value[value > -np.inf]
        self.query.append(q + rows.start)
        self.score.append(value)
        self.id.append(ids[c])
        both = np.concatenate([self.best[rows], scores], 1)
        self.best[rows] = -np.sort(np.partition(-both, self.k - 1, axis=1)[:, : self.k], 1)
        if sum(map(len, self.query)) > 200_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, s, i = (np.concatenate(x) for x in (self.query, self.score, self.id))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, np.arange(len(self.best)))
        keep = np.arange(len(q)) - first[q] < self.k
        self.query, self.score, self.id = [q[keep]], [s[keep]], [i[keep]]
        return q[keep], s[keep], i[keep]


def search(queries: CoverTree, query_ids: np.ndarray, candidates: CoverTree, candidate_ids: np.ndarray, answers: Answers) -> None:
    """Adds the candidates that can be among the k best of any query."""

    def worst(i: np.ndarray) -> np.ndarray:
        return np.array([answers.best[a:b, -1].min() for a, b in queries.span[i]])

    i = j = np.zeros(1, np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(i):
        groups, back = np.unique(i, return_inverse=True)
        keep = bounds(queries, i, candidates, j) >= worst(groups)[back]
        i, j = i[keep], j[keep]
        done = (queries.child[i, 1] == 0) & (candidates.child[j, 1] == 0)
        leaves.append((i[done], j[done]))
        i, j = i[~done], j[~done]
        # The node with the larger radius is opened, if it has children.
        open_q = (queries.child[i, 1] > 0) & ((candidates.child[j, 1] == 0) | (queries.radius[i] > candidates.radius[j]))
        n = np.where(open_q, queries.child[i, 1], candidates.child[j, 1])
        first = np.where(open_q, queries.child[i, 0], candidates.child[j, 0])
        which = np.repeat(np.arange(len(i)), n)
        node = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = np.where(open_q[which], node, i[which]), np.where(open_q[which], j[which], node)
    i, j = (np.concatenate(x) for x in zip(*leaves, strict=True))
    for leaf in np.unique(i):
        own = j[i == leaf]
        limit = bounds(queries, np.full(len(own), leaf), candidates, own)
        order = np.argsort(-limit, kind="stable")
        own, limit = own[order], limit[order]
        rows = slice(*map(int, queries.span[leaf]))
        size = np.diff(candidates.span[own], axis=1)[:, 0]
        at = 0
        while at < len(own) and limit[at] >= answers.best[rows, -1].min():
            end = at + max(1, int(np.searchsorted(np.cumsum(size[at : at + STEP]), STEP)))
            place = ragged(candidates.span[own[at:end], 0], size[at:end])
            at = end
            scores = queries.points[rows] @ candidates.points[place].T
            scores[query_ids[rows][:, None] == candidate_ids[place][None, :]] = -np.inf
            answers.offer(rows, scores, candidate_ids[place])


def pivots_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """A few vectors of each length among a bounded sample, by hash of the id."""
    found: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(8 * PIVOTS).select("x").collect():
        found.setdefault(len(r.x), []).append(r.x)
    return {d: np.array(x[:PIVOTS], np.float64) for d, x in found.items() if d}


def near_pivots(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(id, x, dimension, pivot, away): the nearest pivot of each row and the distance to it; without one, pivot -1."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches):
        for batch in batches:
            length = np.diff(batch.column(1).offsets.to_numpy())
            out, away = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, np.inf)
            for d, heads in shared.value.items():
                own = np.flatnonzero(length == d)
                if len(own):
                    x = batch.column(1).take(pa.array(own)).flatten().to_numpy().reshape(len(own), d)
                    out[own] = np.argmin((heads**2).sum(1)[None, :] - 2 * x @ heads.T, 1)
                    away[own] = np.sqrt(((x - heads[out[own]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length, pa.int32()), pa.array(out), pa.array(away)], names=["id", "x", "dimension", "pivot", "away"])

    return rows.select("id", "x").mapInArrow(thrifty(nearest), "id long, x array<double>, dimension int, pivot int, away double")


def blocks_of(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt into blocks of about ``size``, near ones together: (block, id, x), and the table of blocks with their radii."""
    group = ["dimension", "pivot"]
    sizes = saved(rows.groupBy(*group).agg(F.ceil(F.count("*") / size).alias("parts")), f"{name}-counts")
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    numbered = saved(rows.join(sizes, group).select(F.xxhash64(*group, part).alias("block"), *group, "away", "id", "x"), f"{name}-blocks")
    table = saved(numbered.groupBy("block", *group).agg(F.max("away").alias("radius"), F.count("*").alias("n")), f"{name}-table")
    return numbered.select("block", "id", "x"), table


def top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 20, scale: float = 64.0, query_block: int = 2048, candidate_block: int = 4096, together: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products of floor(scale * x).

    ``is_query`` is a condition on the id, called id. Fewer than k rows come only where there are
    fewer candidates.
    """
    scaled = F.transform(finite(vector), lambda v: v.cast("double") * scale)
    whole = F.transform(scaled, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))  # larger doubles are whole
    rows = df.select(F.col(key).cast("long").alias("id"), whole.alias("x"))
    rows = rows.where("id IS NOT NULL AND x IS NOT NULL")
    pivots = pivots_of(rows)
    near = saved(near_pivots(rows, pivots), "near-pivots")
    points, candidates = blocks_of(near, candidate_block, "candidate")
    once = near.where(is_query).groupBy("id").agg(F.min(F.struct("x", "dimension", "pivot", "away")).alias("s"))
    asked, queries = blocks_of(once.select("id", "s.*"), query_block, "query")
    lanes_q, lanes_c = (max(1, -(-t.count() // together)) for t in (queries, candidates))
    bound = block_bound(pivots)

    def run(batches):
        trees: dict[int, tuple] = {}
        meets: dict[int, list[int]] = {}
        for part in cells(batches, ["lane_q", "lane_c", "role", "block"]):
            role, block = part["role"][0].as_py(), part["block"][0].as_py()
            if role == 1:
                for q, c in zip(part["block"].to_pylist(), part["id"].to_pylist(), strict=True):
                    meets.setdefault(c, []).append(q)
                continue
            if role == 0 and meets:  # the next cell of the grid begins
                yield from answers_of(trees)
                trees, meets = {}, {}
            own, x = part["id"].to_numpy(), part["x"].combine_chunks()
            made = CoverTree(x.flatten().to_numpy().reshape(len(own), -1), LEAF if role else QUERY_LEAF)
            if role == 0:
                trees[block] = (made, own[made.order], Answers(len(own), k), [])
                continue
            for q in meets.get(block, []):
                tree, ids, answers, big = trees[q]
                if tree.largest * made.largest < 2.0**53:
                    search(tree, ids, made, own[made.order], answers)
                else:
                    big += exact_best(tree.points, ids, made.points, own[made.order], k)
        yield from answers_of(trees)

    def answers_of(trees):
        for _, ids, answers, big in trees.values():
            q, s, i = answers.settle()
            score = [int(x) for x in s.tolist()] + [x for _, x, _ in big]
            if big and not -(1 << 63) <= min(score) <= max(score) < 1 << 63:
                raise ValueError("a score does not fit a long")
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[q], ids[[r for r, _, _ in big]]]) if big else ids[q]), pa.array(i.tolist() + [x for _, _, x in big], pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    def met(pairs: DataFrame) -> DataFrame:
        """query_id, vec_id, score of the best of each block of queries in some blocks of candidates; pairs has q, c."""
        lane = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
        grid = saved(pairs.select("q", "c", lane("q", lanes_q).alias("lane_q"), lane("c", lanes_c).alias("lane_c")), "block-pairs")
        none = F.lit(None).cast("array<double>")
        asked_in = asked.join(grid.select(F.col("q").alias("block"), "lane_q", "lane_c").distinct(), "block").select("lane_q", "lane_c", F.lit(0).alias("role"), "block", "id", "x")
        pairs_in = grid.select("lane_q", "lane_c", F.lit(1).alias("role"), F.col("q").alias("block"), F.col("c").alias("id"), none.alias("x"))
        points_in = points.join(grid.select(F.col("c").alias("block"), "lane_q", "lane_c").distinct(), "block").select("lane_q", "lane_c", F.lit(2).alias("role"), "block", "id", "x")
        dealt = asked_in.union(pairs_in).union(points_in).repartition("lane_q", "lane_c").sortWithinPartitions("lane_q", "lane_c", "role", "block")
        return saved(dealt.mapInArrow(thrifty(run), "query_id long, vec_id long, score long"), "best-in-blocks")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    one = candidates.groupBy("dimension", "pivot").agg(F.min_by("block", -F.col("n")).alias("c"))
    seeds = saved(queries.join(one, ["dimension", "pivot"]).select(F.col("block").alias("q"), "c"), "seed-pairs")
    first = met(seeds)
    enough = first.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", "score")
    worst = asked.select(F.col("block").alias("q"), F.col("id").alias("query_id")).join(enough, "query_id", "left").groupBy("q").agg(F.min(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))).alias("worst"))
    left = queries.select(F.col("block").alias("q"), "dimension", F.col("pivot").alias("pivot_q"), F.col("radius").alias("radius_q")).join(worst, "q")
    right = candidates.select(F.col("block").alias("c"), "dimension", F.col("pivot").alias("pivot_c"), F.col("radius").alias("radius_c"))
    pairs = left.join(right, "dimension")  # pairs of blocks, not of rows: a few numbers each
    pairs = bound(pairs).where("bound >= worst").select("q", "c").join(seeds, ["q", "c"], "left_anti")
    found = first.union(met(pairs))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_bound(pivots: dict[int, np.ndarray]):
    """Adds ``bound`` to pairs of blocks, from the inner products of their pivots: no pair of their rows has a larger one."""

    def add(pairs: DataFrame) -> DataFrame:
        table = [(d, a, b, float(x @ y), float(np.linalg.norm(x)), float(np.linalg.norm(y))) for d, heads in pivots.items() for a, x in enumerate(heads) for b, y in enumerate(heads)]
        known = pairs.sparkSession.createDataFrame(table, "dimension int, pivot_q int, pivot_c int, inner_ double, norm_q double, norm_c double")
        rows = pairs.join(F.broadcast(known), ["dimension", "pivot_q", "pivot_c"], "left")  # PIVOTS squared for each length sampled
        q, c, rq, rc = (F.col(n) for n in ("norm_q", "norm_c", "radius_q", "radius_c"))
        bound = F.col("inner_") + q * rc + c * rq + rq * rc + 1e-6 + 1e-12 * (q + rq) * (c + rc)
        return rows.withColumn("bound", F.coalesce(bound, F.lit(float("inf"))))

    return add
