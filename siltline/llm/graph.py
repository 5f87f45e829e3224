"""Connected components by alternating star steps on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """One row (id, component) per vertex that is not its component's smallest; ``edges`` has a, b.

    Each round hangs every vertex's larger neighbours on its smallest one, then its smaller ones.
    Both sides of each join are plain tables, so a vertex with very many edges is split by the
    engine; the minima are pre-aggregated. Loops and repeated edges change nothing. The sum of all labels
    falls in each round that is not the last, so the rounds end.
    """
    edge = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        old, first = edge, saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = saved(both.where("v > u").join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("n")), "low")
        hung = large.join(low.where("n > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = saved(low.select("u", F.col("m").alias("v")).union(hung).distinct(), "small-star")
        discard(old, first, large, low)
        # Done once all edges point from a vertex that has one edge to one that has none of its own.
        above = edge.select(F.col("u").alias("x")).distinct()
        if edge.join(above, edge["v"] == above["x"], "left_semi").limit(1).count() == 0:
            return edge.select(F.col("u").alias("id"), F.col("v").alias("component"))
