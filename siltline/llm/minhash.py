"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch is the ``k`` smallest.
Copies (equal sets) are one class from the start. For the classes:

1. Inverted lists of the retained values give overlaps. Two sets of similarity 0.75 share the least
   where one holds the other: then each of k retained values of the greater set is shared with
   chance 0.75, and fewer than ``least_shared`` (23 of 48) are in 1 of 67,000 trials. Sets below k
   are retained whole, and share OVERLAP of their values for certain. So each sketch needs only its
   rarest values: enough that two sketches which share that many values share one of these.
2. In each list all members meet one of them, drawn by hash and so another in each list. The union
   sketch estimates the similarity (below ``least_shared`` at 0.75: 1 of 67,000, in the nested case
   the same trials as in 1); pairs that pass are verified on full sets, and linked.
3. Members of a list that are not yet in one component all meet, in blocks of bounded size, each
   pair in the first list that it shares; blocks of one and the same component do not meet. Wider sketches, which are the full sets of documents of
   up to WIDE shingles, estimate them; then the same check. So no pair that shares a list is left out.

Links are exact (full sets of 63-bit hashes). The result gives components, not all pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltline.llm.blocks import cells, strangers
from siltline.llm.common import BROADCAST_IDS, WordHashes, binary_list, bounded_batches, discard, saved, shingle_hashes, text_bytes, thrifty, words_of
from siltline.llm.graph import components

#: Values of a sketch, and share of its values that a set below K shares at least with one of similarity 0.75.
K, OVERLAP = 48, 0.6
#: How often the sketches of two sets at the threshold may share too little.
ODDS = 1 / 40_000
#: Values of the wider sketch, and standard deviations that its estimate may lie too low.
WIDE, LOW = 192, 4.2


def shingle_sets(rows: DataFrame, width: int, k: int | None) -> DataFrame:
    """Per row of (id, t): id, n (size of the set), digest and sketch; or id and the full set if k is None."""

    def work(batches):
        hashes = WordHashes()
        for batch in batches:
            n, digest, edge, values = [], [], [0], []
            for text in binary_list(batch.column(1)):
                found = np.sort(shingle_hashes(hashes.of(words_of(text)), width) >> np.uint64(1)).astype(np.int64)
                found = np.unique(found)
                n.append(len(found))
                digest.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                values.append(found if k is None else found[:k])
                edge.append(edge[-1] + len(values[-1]))
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))
            if k is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "shingles"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], names=["id", "n", "digest", "sketch"])

    return rows.mapInArrow(thrifty(work), "id long, shingles array<long>" if k is None else "id long, n long, digest binary, sketch array<long>")


def least_shared(k: int, percent: int) -> int:
    """The most values of k that two sets at the threshold share in all but ODDS of trials, one at least."""
    share, below = percent / 100, 0.0
    for m in range(k):
        below += comb(k, m) * share**m * (1 - share) ** (k - m)
        if below > ODDS:
            return max(m, 1)
    return k


def estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the k smallest values of the union that both sketches hold."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def near_in_size(percent: int) -> Column:
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.least("na", "nb") > 0)


def estimated(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of near sizes whose union sketch shares enough of its values."""
    pairs = pairs.where(near_in_size(percent))
    one = reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    two = reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(one, "a").join(two, "b").where(estimate(F.col("sa"), F.col("sb"), k) >= least_shared(k, percent) / k).select("a", "b", "na", "nb")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose full sets have 100 * intersection >= percent * union."""
    ids = saved(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = saved(shingle_sets(texts.join(wanted, "id", "left_semi").select("id", "t"), width, None), "full-sets")
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", both.alias("both"))
    return joined.where(F.col("both") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def cross_pairs(members: DataFrame, percent: int, block: int = 1024, columns: int = 8192) -> DataFrame:
    """Pairs (a, b, na, nb) of different components within lists, estimated in blocks.

    ``members`` has v, id, n, component, rare (the values whose lists the id is in) and wide.
    """
    share = percent / 100

    def incidence(lists: pa.ListArray):
        size = np.diff(lists.offsets.to_numpy())
        value, at, n = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row, at = np.repeat(np.arange(len(size)), size)[n[at] > 1], at[n[at] > 1]
        column = np.cumsum(n > 1) - 1
        return row, column[at], int((n > 1).sum()), value[n > 1]

    def compare(batches):
        for cell in cells(batches, ["v", "left_block", "right_block"]):
            cell = cell.combine_chunks()
            block, side, v = cell["block"].to_numpy(), cell["left_block"][0].as_py(), cell["v"][0].as_py()
            ids, n, component = (cell[c].to_numpy() for c in ("id", "n", "component"))
            left, right = np.flatnonzero(block == side), np.flatnonzero(block == cell["right_block"][0].as_py())
            small, great = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
            fit = (component[left][:, None] != component[right][None, :]) & (100 * small >= percent * great)
            if not fit.any():
                continue
            wide = cell["wide"].chunk(0)
            edge = wide.offsets.to_numpy()
            values, edge = wide.flatten().to_numpy(), edge - edge[0]
            size = np.diff(edge)
            row, at, width, _ = incidence(wide)
            overlap = np.zeros(fit.shape, np.float32)
            for a in range(0, width, columns):
                own = (at >= a) & (at < a + columns)
                has = np.zeros((len(ids), min(columns, width - a)), np.float32)
                has[row[own], at[own] - a] = 1
                overlap += has[left] @ has[right].T
            # Up to the lower of the two largest values both sketches are complete, so there the union is known.
            top = np.where(size < n, np.array([values[e - 1] for e in edge[1:]]), np.iinfo(np.int64).max)
            below = lambda x, y: np.stack([np.searchsorted(values[edge[i] : edge[i + 1]], top[y], "right") for i in x])
            union = np.minimum(below(left, right), size[left][:, None]) + np.minimum(below(right, left), size[right][:, None]).T - overlap
            complete = (size >= n)[left][:, None] & (size >= n)[right][None, :]
            slack = np.where(complete, 1 / np.maximum(union, 1), LOW * np.sqrt(share * (1 - share) / np.maximum(union, 1)))
            x, y = np.nonzero(fit & (overlap >= (share - slack) * union))
            x, y = left[x], right[y]
            once = ids[x] < ids[y] if side == cell["right_block"][0].as_py() else ids[x] != ids[y]
            x, y = x[once], y[once]
            if not len(x):
                continue
            row, at, width, value = incidence(cell["rare"].chunk(0))  # v is the first list that the pair shares
            has = np.zeros((len(ids), max(width, 1)), bool)
            has[row, at] = True
            has = has[:, : int(np.searchsorted(value, v))]
            first = np.concatenate([~(has[x[a : a + 4096]] & has[y[a : a + 4096]]).any(1) for a in range(0, len(x), 4096)])
            x, y = x[first], y[first]
            a, b = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(n[a]), pa.array(n[b])], names=["a", "b", "na", "nb"])

    return strangers(members, "v", "id", "component", block).mapInArrow(thrifty(compare), "a long, b long, na long, nb long")


def near_duplicates(docs: DataFrame, key: str, text: str, width: int = 5, percent: int = 75, k: int = K) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable), kept.

    Null and empty texts have no shingles and link with nothing. Repeated rows are returned each. Of an id
    with several texts the smallest, by its bytes, links for all its rows; each row has its own size.
    A row whose id is null takes the component of its copies, if they have ids, and links no others;
    it is kept only where it has none.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("id"), text_bytes(text).alias("t"))
    several = saved(texts.where("id IS NOT NULL").groupBy("id").agg(F.min(F.xxhash64("t")).alias("a"), F.max(F.xxhash64("t")).alias("b")).where("a <> b").select("id"), "ids-of-several-texts")
    rows = linking = saved(shingle_sets(texts, width, k), "sketches")
    again = several.count()
    if again:
        few = F.broadcast(several) if again <= BROADCAST_IDS else several
        texts = texts.join(few, "id", "left_anti").unionByName(texts.join(few, "id").groupBy("id").agg(F.min("t").alias("t")))
        linking = saved(shingle_sets(texts, width, k), "linking-sketches")
    reps = saved(linking.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "classes")

    entries = reps.select("id", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    shared = saved(entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared-values")
    found = entries.join(shared, "v")
    by_doc = Window.partitionBy("id")
    need = F.when(F.col("size") < k, F.ceil(F.col("size") * OVERLAP)).otherwise(least_shared(k, percent))
    ranked = found.withColumns({"matched": F.count("*").over(by_doc), "rank": F.row_number().over(by_doc.orderBy("df", "v"))})
    rare = ranked.where((F.col("matched") >= need) & (F.col("size") - F.col("matched") + F.col("rank") <= F.col("size") - need + 1))
    lists = saved(rare.select("v", "id", "n"), "rare-values")

    centre = saved(lists.groupBy("v").agg(F.min_by(F.struct("id", "n"), F.xxhash64("v", "id")).alias("c"), F.count("*").alias("members")).where("members > 1").select("v", F.col("c.id").alias("c"), F.col("c.n").alias("nc")), "centres")
    star = lists.join(centre, "v").where("id <> c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"), F.when(F.col("id") < F.col("c"), F.col("n")).otherwise(F.col("nc")).alias("na"), F.when(F.col("id") < F.col("c"), F.col("nc")).otherwise(F.col("n")).alias("nb"))
    tried = saved(estimated(star.where(near_in_size(percent)).distinct(), reps, k, percent), "star-pairs")
    links = saved(verified(tried, texts, width, percent), "star-links")
    first = saved(components(links), "star-components")
    discard(shared, centre)

    members = lists.join(first, "id", "left").select("v", "id", "n", F.coalesce("component", "id").alias("component"))
    members = saved(members, "members")
    mixed = saved(members.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low <> high AND m > 2").select("v"), "mixed-lists")
    rest = saved(members.join(mixed, "v"), "mixed-members")
    wanted = saved(rest.groupBy("id").agg(F.sort_array(F.collect_list("v")).alias("rare")), "mixed-ids")  # k lists at most
    chosen = F.broadcast(wanted.select("id")) if wanted.count() <= BROADCAST_IDS else wanted.select("id")
    wide = shingle_sets(texts.join(chosen, "id", "left_semi").select("id", "t"), width, WIDE).dropDuplicates(["id"])
    wide = saved(wide.select("id", F.transform("sketch", lambda x: F.shiftright(x, 31)).alias("wide")).join(wanted, "id"), "wide-sketches")
    crossing = saved(cross_pairs(rest.join(wide, "id"), percent).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "cross-pairs")
    more = saved(verified(crossing, texts, width, percent), "cross-links")
    whole = components(links.union(more)) if not more.isEmpty() else first

    named = reps.where("copies > 1").select("digest", "id").union(reps.join(whole.select("id"), "id", "left_semi").select("digest", "id")).distinct()
    named = saved(named.join(whole, "id", "left").select("digest", F.coalesce("component", "id").alias("component")), "named")
    out = rows.select("id", "n", "digest").join(named, "digest", "left")
    if again:
        own = linking.join(few, "id").join(named, "digest", "left").select("id", F.coalesce("component", "id").alias("own"))
        out = out.join(own, "id", "left").withColumn("component", F.coalesce("own", "component"))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
