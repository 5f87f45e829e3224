"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Every unit vector is projected on random directions, PROJECTIONS for 10,000 vectors and more with the
power GROWTH of their number: so the pairs that meet by chance grow about as the vectors do, as long as a task can hold
the directions (33 million vectors of 64 components). In each direction, taken both
ways, the vectors are sorted by their value, and a vector keeps its place in the ``retained``
directions where its value is largest: only there it asks. Its window in such a direction holds
the vectors that keep it too and whose value lies within REACH standard deviations of a pair at the
threshold. A pair that collides in COUNT windows at least is verified; how many directions are
retained is calibrated so that pairs exactly at the threshold reach that count with probability
``recall``, and it is an error if no number does.

Places are sorted by two directions and the value in the first, so a run of one pair of directions is
short, and a pair of vectors that collides c times meets in c (c - 1) / 2 runs. Only places and ids
are shuffled: windows give pairs of ids, these are counted, and vectors are fetched for the pairs that
pass. Pairs of directions that more than ``light`` vectors keep are heavy. There the members meet in
blocks with their vectors, pairs are counted inside a block, and each pair is verified under the
smallest heavy pair of directions that it shares, so blocks give sums of links and the smallest
linked vector, never all pairs. Equal vectors are one row with a weight from the start.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do rows
without an id; vectors of different lengths do not link. Repeated rows are returned each. Of an id
with several usable vectors the smallest, in the order of their components, counts for all its rows
with a usable one; its other rows have no links and are their own component.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.llm.blocks import block_pairs, cells
from siltline.llm.common import BROADCAST_IDS, saved, thrifty
from siltline.llm.graph import components

PROJECTIONS, REACH, COUNT, MOST = 2048, 3.5, 3, 48
#: Vectors for which PROJECTIONS are meant, the power of more vectors with which directions grow (neighbouring directions go together, so the
#: root would be too few), and numbers of which a task holds the directions at most.
MEANT, GROWTH, HELD = 10_000, 0.85, 1 << 27
#: A value v is kept as a number of steps from LOW to -LOW, of 16 bits or what two directions leave of 62.
LOW = -8.0


def finite(vector: str | Column) -> Column:
    """The vector, or null unless all its components are finite numbers."""
    c = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(c.isNotNull() & ~bad, c)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def projections_for(vectors: int) -> int:
    """A multiple of 64 that grows with the number of vectors to the power GROWTH, from PROJECTIONS on."""
    return max(PROJECTIONS, 64 * round(PROJECTIONS * (vectors / MEANT) ** GROWTH / 64))


def step_bits(projections: int) -> int:
    return min(16, (62 - 2 * (2 * projections - 1).bit_length()) // 2)


@functools.lru_cache(maxsize=4)
def directions(dimension: int, n: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed + dimension).standard_normal((dimension, n)).astype(np.float32)


def strongest(unit: np.ndarray, to: np.ndarray, retained: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Signed directions of the largest projections of each row, ascending, and their values; ``most`` projections at once."""
    tops, values = [np.zeros((0, retained), np.int32)], [np.zeros((0, retained), np.float32)]
    rows = max(1, most // to.shape[1])
    for a in range(0, len(unit), rows):
        value = unit[a : a + rows].astype(np.float32) @ to
        value = np.concatenate([value, -value], 1)
        top = np.sort(np.argpartition(-value, retained - 1, axis=1)[:, :retained], 1)
        tops.append(top.astype(np.int32))
        values.append(np.take_along_axis(value, top, 1))
    return np.concatenate(tops), np.concatenate(values)


@functools.lru_cache(maxsize=64)
def calibrated(dimension: int, threshold: float, projections: int, recall: float, trials: int = 3000) -> int:
    """Fewest retained directions with which pairs at the threshold collide COUNT times that often."""
    rng, to = np.random.default_rng(17), directions(dimension, projections)
    x, y = rng.standard_normal((2, trials, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * y
    most = min(MOST, projections)
    (dx, vx), (dy, vy) = (ordered(*strongest(v, to, most)) for v in (x, y))
    for retained in range(COUNT + 1, most + 1):
        own = (a[:, :retained] for a in (dx, vx, dy, vy))
        if (collisions(*own, window(threshold)) >= COUNT).mean() >= recall:
            return retained
    raise ValueError(f"no {MOST} of {projections} directions reach a recall of {recall} at {threshold} in {dimension} dimensions")


def ordered(top: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and values of each row, the largest value first."""
    at = np.argsort(-value, 1)
    return np.take_along_axis(top, at, 1), np.take_along_axis(value, at, 1)


def retained_for(dimension: int, threshold: float, projections: int, recall: float) -> int:
    """Calibrated at the powers of two around the dimension, so that few numbers are ever needed."""
    if dimension < 2:
        return COUNT + 1
    low = 1 << (dimension.bit_length() - 1)
    return max(calibrated(d, threshold, projections, recall) for d in ({low} if dimension == low else {low, 2 * low}))


def window(threshold: float) -> float:
    return REACH * float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6


def collisions(dx: np.ndarray, vx: np.ndarray, dy: np.ndarray, vy: np.ndarray, reach: float) -> np.ndarray:
    """In how many directions each x has the y of the same row in its window."""
    return ((dx[:, :, None] == dy[:, None, :]) & (np.abs(vx[:, :, None] - vy[:, None, :]) <= reach)).any(2).sum(1)


def whole_runs(batches, shift: int):
    """Places and ids of whole runs of one pair of directions (a place shifted right), from sorted batches."""
    at, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        at, ids = np.concatenate([at, batch.column(0).to_numpy()]), np.concatenate([ids, batch.column(1).to_numpy()])
        cut = int(np.searchsorted(at >> shift, at[-1] >> shift)) if len(at) else 0
        yield at[:cut], ids[:cut]
        at, ids = at[cut:], ids[cut:]
    yield at, ids


def by_id(names: list[str], suffix: str) -> list[Column]:
    return [F.col(n).alias(n + suffix) for n in names]


def near_vectors(df: DataFrame, key: str, vector: str, threshold: float = 0.95, projections: int | None = None, recall: float = 0.999, light: int = 64, block: int = 256) -> DataFrame:
    """Per row of ``df``: vec_id, n_links (other vectors linked directly), component_id, kept."""
    rows = df.select(F.col(key).cast("long").alias("id"), finite(vector).alias("x"))
    one = rows.where("id IS NOT NULL AND x IS NOT NULL AND exists(x, v -> v <> 0)").groupBy("id").agg(F.min("x").alias("x"))
    classes = saved(one.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    reach, kind = window(threshold), classes.schema["x"].dataType.simpleString()
    asked = projections or projections_for(classes.count())
    longest = classes.agg(F.max(F.size("x"))).first()[0] or 1
    projections = max(min(asked, PROJECTIONS), min(asked, HELD // longest))
    bits = step_bits(projections)
    step_size = -2 * LOW / (1 << bits)

    def project(batches):
        for batch in batches:
            length = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(length):
                own = np.flatnonzero(length == d)
                part = batch.take(pa.array(own))
                unit = unit_rows(part.column(1).flatten().to_numpy().reshape(len(own), d))
                top, value = strongest(unit, directions(int(d), projections), retained_for(int(d), threshold, projections, recall))
                edge = pa.array(np.arange(len(own) + 1) * top.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), part.column(1), pa.ListArray.from_arrays(edge, pa.array(top.reshape(-1))), pa.ListArray.from_arrays(edge, pa.array(value.astype(np.float32).reshape(-1))),
                ], names=["id", "copies", "x", "top", "value"])

    def place(batches):
        for batch in batches:
            held = np.diff(batch.column(1).offsets.to_numpy())
            for r in np.unique(held):
                own = np.flatnonzero(held == r)
                part = batch.take(pa.array(own))
                top, value = (part.column(c).flatten().to_numpy().reshape(len(own), r) for c in (1, 2))
                step = np.clip((value - LOW) / step_size, 0, (1 << bits) - 1).astype(np.int64)
                for a, b in itertools.combinations(range(r), 2):
                    at = (((top[:, a].astype(np.int64) * (2 * projections) + top[:, b]) << bits | step[:, a]) << bits) | step[:, b]
                    yield pa.RecordBatch.from_arrays([pa.array(at), part.column(0)], names=["at", "id"])

    def windows(batches):
        wide, low = int(reach / step_size) + 2, (1 << bits) - 1
        for at, ids in whole_runs(batches, 2 * bits):
            run, first, second = at >> 2 * bits, at >> bits & low, at & low
            for o in range(1, light):
                same = run[o:] == run[:-o]
                if not same.any():
                    break
                i = np.flatnonzero(same & (first[o:] - first[:-o] <= wide) & (np.abs(second[o:] - second[:-o]) <= wide))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[i + o])), pa.array(np.maximum(ids[i], ids[i + o]))], names=["a", "b"])

    projected = saved(classes.select("id", "x", "copies").mapInArrow(thrifty(project), f"id long, copies long, x {kind}, top array<int>, value array<float>"), "projections")
    places = saved(projected.select("id", "top", "value").mapInArrow(place, "at long, id long"), "places").withColumn("run", F.shiftright("at", 2 * bits))
    heavy = saved(places.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > light).select("run"), "heavy-runs")
    few = F.broadcast(heavy) if heavy.count() <= BROADCAST_IDS else heavy
    held = places.join(few, "run")
    hot = saved(held.groupBy("id").agg(F.sort_array(F.collect_list("run")).alias("runs")), "heavy-members")  # a vector's runs: some hundreds at most

    sorted_places = places.join(few, "run", "left_anti").repartition("run").sortWithinPartitions("at", "id").select("at", "id")
    met = sorted_places.mapInArrow(windows, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n"))
    passed = saved(met.where(F.col("n") >= COUNT * (COUNT - 1) // 2).select("a", "b"), "counted-pairs")
    full = projected.join(hot, "id", "left").select("id", "copies", "x", "runs")
    both = passed.join(full.select(*by_id(full.columns, "_a")).withColumnRenamed("id_a", "a"), "a").join(full.select(*by_id(full.columns, "_b")).withColumnRenamed("id_b", "b"), "b")
    both = both.where(~F.coalesce(F.arrays_overlap("runs_a", "runs_b"), F.lit(False)) & (F.size("x_a") == F.size("x_b")))

    def verify(batches):
        for batch in batches:
            length = np.diff(batch.column(2).offsets.to_numpy())
            near = np.zeros(batch.num_rows, bool)
            for d in np.unique(length):
                own = np.flatnonzero(length == d)
                x, y = (unit_rows(batch.column(c).take(pa.array(own)).flatten().to_numpy().reshape(len(own), d)) for c in (2, 3))
                near[own] = (x * y).sum(1) >= threshold
            a, b, copies_a, copies_b = (batch.column(i).to_numpy()[near] for i in (0, 1, 4, 5))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([a, b]), np.concatenate([copies_b, copies_a]), np.concatenate([a, a]))], names=["id", "links", "root"])

    def meet(batches):
        for cell in cells(batches, ["run", "left_block", "right_block"]):
            cell = cell.combine_chunks()
            run, side, other = (cell[c][0].as_py() for c in ("run", "left_block", "right_block"))
            blocks, length = cell["block"].to_numpy(), np.diff(cell["x"].chunk(0).offsets.to_numpy())
            for d in np.unique(length):
                part = cell.take(pa.array(np.flatnonzero(length == d))).combine_chunks()
                ids, copies, own_block = (part[c].to_numpy() for c in ("id", "copies", "block"))
                x, top, value = (part[c].chunk(0).flatten().to_numpy().reshape(len(ids), -1) for c in ("x", "top", "value"))
                left, right = np.flatnonzero(own_block == side), np.flatnonzero(own_block == other)
                if not len(left) or not len(right):
                    continue
                runs = part["runs"].chunk(0)
                smaller = np.zeros((len(ids), len(np.unique(runs.flatten().to_numpy()))), np.float32)
                kinds, at = np.unique(runs.flatten().to_numpy(), return_inverse=True)
                smaller[np.repeat(np.arange(len(ids)), np.diff(runs.offsets.to_numpy())), at] = 1
                smaller = smaller[:, : int(np.searchsorted(kinds, run))]
                kinds, at = np.unique(top, return_inverse=True)
                keeps = np.zeros((len(ids), len(kinds)), np.float32)
                keeps[np.arange(len(ids))[:, None], at.reshape(top.shape)] = 1
                a, b = np.nonzero((keeps[left] @ keeps[right].T > COUNT - 0.5) & (smaller[left] @ smaller[right].T < 0.5))
                a, b = left[a], right[b]
                if side == other:
                    a, b = a[ids[a] < ids[b]], b[ids[a] < ids[b]]
                counted = np.concatenate([np.zeros(0, bool), *(collisions(top[a[i : i + 4096]], value[a[i : i + 4096]], top[b[i : i + 4096]], value[b[i : i + 4096]], reach) >= COUNT for i in range(0, len(a), 4096))])
                a, b, unit = a[counted], b[counted], unit_rows(x)
                near = np.concatenate([np.zeros(0, bool), *((unit[a[i : i + 4096]] * unit[b[i : i + 4096]]).sum(1) >= threshold for i in range(0, len(a), 4096))])
                a, b = a[near], b[near]
                if not len(a):
                    continue
                links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
                root = smallest_reachable(ids, a, b)
                found = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(links[found].astype(np.int64)), pa.array(root[found])], names=["id", "links", "root"])

    schema = "id long, links long, root long"
    light_links = both.select("a", "b", "x_a", "x_b", "copies_a", "copies_b").mapInArrow(verify, schema)
    members = held.select("run", "id").join(hot, "id").join(projected, "id")
    partial = saved(light_links.union(block_pairs(members, "run", "id", block).mapInArrow(thrifty(meet), schema)), "vector-links")
    links = partial.groupBy("id").agg(F.sum("links").alias("links"))
    whole = components(partial.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "id", "left").join(whole, "id", "left").where("copies > 1 OR links IS NOT NULL OR component IS NOT NULL")
    named = saved(named.select("x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component")), "named-vectors")
    usable = F.col("x").isNotNull() & F.exists("x", lambda v: v != 0)
    out = rows.select("id", usable.alias("usable")).join(one.join(named, "x").select("id", "n", "component"), "id", "left")
    out = out.withColumns({c: F.when(F.col("usable"), F.col(c)) for c in ("n", "component")})
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def smallest_reachable(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id that each member reaches over the edges a, b."""
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if np.array_equal(new, root):
            return root
        root = new
