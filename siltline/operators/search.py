"""Vector search over published items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from siltline.config import Search
from siltline.functions import vectors as V


def searchable(days: DataFrame, dimensions: int) -> DataFrame:
    """Days whose vectors are int8 of the wanted width."""
    return days.where(F.col("vectors").isNotNull() & (F.col("dtype") == "int8") & (F.col("dimensions") == dimensions))


def with_vectors(items: DataFrame, days: DataFrame) -> DataFrame:
    """Items with their day's vector; one without is left out."""
    rows = items.join(days.select("day", "vectors"), "day").withColumn("vector", F.try_element_at("vectors", F.col("item_id")))
    return rows.where(F.col("vector").isNotNull()).drop("vectors")


def rank(items: DataFrame, query: Column, vector: str, date: str, key: str, config: Search = Search()) -> DataFrame:
    """The best items for one query vector (a literal): score at least the least, newest and smallest id first among equals.

    The query travels in the plan as a literal, so nothing is joined; each task keeps its best few.
    """
    score = F.bround(V.dot(F.col(vector), query), 6)
    hits = items.withColumn("score", score).where(F.col("score") >= config.min_score)
    return hits.orderBy(F.desc("score"), F.desc(date), F.asc(key)).limit(config.limit)


def _matrix(rows: pa.Table) -> np.ndarray:
    """The vectors of the column x, one a row; null components are NaN."""
    lists = rows["x"].combine_chunks()
    widths = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(widths) > 1:
        raise ValueError("vectors of different lengths")
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), widths[0] if widths else 0)


def rank_each(items: DataFrame, queries: DataFrame, vector: str, date: str, key: str, query: str, config: Search = Search(), query_block: int = 4096, item_block: int = 1 << 15, scores_at_once: int = 1 << 20) -> DataFrame:
    """query, place and the best items (key, date, score) of each query, in the order of rank().

    Queries and items are dealt into blocks, and every block of queries meets every block of items in a
    group of bounded size, which gives the best of each of its queries. A group holds its two blocks as
    matrices and ``scores_at_once`` scores, never all of them. Vectors of another length than a query's
    are an error.
    """
    blocks, lanes = (max(1, -(-rows.count() // size)) for rows, size in ((queries, query_block), (items, item_block)))
    place = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    text = F.lit(None).cast("string")
    narrow = all(rows.schema[vector].dataType == ArrayType(FloatType(), rows.schema[vector].dataType.containsNull) for rows in (items, queries))
    x = F.col(vector).cast("array<float>" if narrow else "array<double>").alias("x")  # floats travel as floats and are multiplied as doubles
    asked = queries.select(place(query, blocks).alias("block"), every(lanes).alias("lane"), F.col(query).cast("string").alias("q"), text.alias("date"), text.alias("key"), x)
    met = items.select(every(blocks).alias("block"), place(key, lanes).alias("lane"), text.alias("q"), F.col(date).cast("string").alias("date"), F.col(key).cast("string").alias("key"), x)
    kinds = pa.schema([("q", pa.string()), ("key", pa.string()), ("date", pa.string()), ("score", pa.float64())])

    def best(group: pa.Table) -> pa.Table:
        asks = pc.is_valid(group["q"])
        names, ours, theirs = group["q"].filter(asks), _matrix(group.filter(asks)), group.filter(pc.invert(asks))
        if not len(names) or not len(theirs):
            return kinds.empty_table()
        order = pc.sort_indices(theirs, [("date", "descending"), ("key", "ascending")])  # equal scores then stand in their order
        theirs = theirs.take(order)
        vectors, rows, hits, scores = _matrix(theirs), [], [], []
        if vectors.shape[1] != ours.shape[1]:
            raise ValueError("vectors of different lengths")
        step = max(1, scores_at_once // len(vectors))
        for a in range(0, len(ours), step):
            part = ours[a : a + step] @ vectors.T
            np.round(part, 6, out=part)
            for j, own in enumerate(part, a):
                found = np.flatnonzero(own >= config.min_score)
                if len(found) > config.limit:
                    nth = np.partition(own[found], len(found) - config.limit)[len(found) - config.limit]
                    found = found[own[found] >= nth]
                found = found[np.argsort(-own[found], kind="stable")][: config.limit]
                rows.append(np.full(len(found), j))
                hits.append(found)
                scores.append(own[found])
        hit = pa.array(np.concatenate(hits))
        return pa.table([names.take(pa.array(np.concatenate(rows))), theirs["key"].take(hit), theirs["date"].take(hit), pa.array(np.concatenate(scores))], schema=kinds)

    hits = asked.unionByName(met).where("x IS NOT NULL").groupBy("block", "lane").applyInArrow(best, "q string, key string, date string, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("date"), "key"))
    return hits.withColumn("place", nth).where(F.col("place") <= config.limit).select(F.col("q").alias(query), "place", F.col("key").alias(key), F.col("date").alias(date), "score")
