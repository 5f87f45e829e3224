"""Exact places in sorted values from histograms: no list of values is gathered, and no group sits in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltline.sources.shared import saved


def running(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """counts (group, value, n) with ``upto``, the rows of its group up to each value.

    The histogram is dealt out by ranges, so a group may lie in many tasks: its rows before a task's
    range are added from a table with a row for each task and group.
    """
    placed = saved(counts.repartitionByRange(*group, value).withColumn("part", F.spark_partition_id()), "histogram")
    totals = placed.groupBy(*group, "part").agg(F.sum("n").alias("own"))
    before = totals.select(*group, "part", (F.sum("own").over(Window.partitionBy(*group).orderBy("part")) - F.col("own")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy(*group, "part").orderBy(value))
    return placed.withColumn("inside", inside).join(before, [*group, "part"]).withColumn("upto", F.col("inside") + F.col("before")).drop("inside", "before", "part")


def histogram(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, m, v, n): how often each value v of each column m occurs in a group; nulls do not count.

    Histograms of parts of the rows add up to that of all: sum n by the other columns.
    """
    own = F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    return rows.select(*group, own).select(*group, "x.*").where("v IS NOT NULL").groupBy(*group, "m", "v").agg(F.count("*").alias("n"))


def medians_of(counts: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Exact medians by group from a histogram, with one row for each value of a group."""
    keys = [*group, "m"]
    places = running(counts, keys, "v")
    total = places.groupBy(*keys).agg(F.max("upto").alias("total"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    middle = places.join(total, keys).groupBy(*keys).agg(((at(F.floor((F.col("total") - 1) / 2)) + at(F.floor(F.col("total") / 2))) / 2).alias("median"))
    return middle.groupBy(*group).agg(*[F.max(F.when(F.col("m") == c, F.col("median"))).alias(c) for c in columns])


def medians(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Exact medians of columns by group; nulls do not count, and rows without a group are left out."""
    return medians_of(histogram(rows, group, columns), group, columns)
