"""Published days: appended, never reordered; counted, and their runs recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_items(previous: DataFrame, items: DataFrame, run_n: int, key: str = "item_id") -> DataFrame:
    """Previous items in their places, then the new ones. Both have day, ``key`` and position.

    ``key`` may be url_key, so that another story with the same number is not lost.
    """
    fresh = items.join(previous.select("day", key), ["day", key], "left_anti").withColumn("introduced_by_run", F.lit(run_n))
    both = previous.withColumn("part", F.lit(0)).unionByName(fresh.withColumn("part", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("position", F.row_number().over(Window.partitionBy("day").orderBy("part", "position"))).drop("part")


def append_runs(previous: DataFrame, run: DataFrame) -> DataFrame:
    """Runs by day and number; one of the same number is replaced."""
    return previous.join(run.select("day", "n"), ["day", "n"], "left_anti").unionByName(run)


def latest_vectors(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors of all items of a day; a new one replaces an old one of its item."""
    return new.unionByName(previous.join(new.select("day", "item_id"), ["day", "item_id"], "left_anti"))


def day_counters(plan: DataFrame, published: DataFrame) -> DataFrame:
    """Per day: planned and failed items, and whether the day is partial."""
    rows = plan.groupBy("day").agg(F.count("*").alias("p")).join(published.groupBy("day").agg(F.count("*").alias("q")), "day", "full").fillna(0, ["p", "q"])
    failed = F.greatest(F.col("p") - F.col("q"), F.lit(0))
    return rows.select("day", F.greatest("p", "q").alias("items_planned"), F.col("q").alias("items_published"), failed.alias("items_failed"), (failed > 0).alias("partial"))


def vertical_counts(published: DataFrame) -> DataFrame:
    return published.groupBy("day", "vertical").agg(F.count("*").alias("count"))


def manifests(plan: DataFrame, summaries: DataFrame, published: DataFrame, run_n: int) -> DataFrame:
    """One run record per day: conditional counts and the sorted different fingerprints."""
    planned = plan.groupBy("day").agg(F.count("*").alias("p"))
    done = summaries.groupBy("day").agg(
        F.count("*").alias("s"), F.count_if(F.col("status") == "ok").alias("items_succeeded"), F.count_if(F.col("status") == "skipped").alias("items_skipped"), F.array_sort(F.collect_set("fingerprint")).alias("fingerprints")
    )
    day = day_counters(plan, published).select("day", "partial")
    rows = planned.join(done, "day", "left").join(day, "day").fillna(0, ["s", "items_succeeded", "items_skipped"])
    total = F.greatest("p", "s")
    return rows.select(
        "day", F.concat("day", F.lit(f"-{run_n}")).alias("run_id"), F.lit(run_n).alias("n"), F.when(F.col("partial"), "partial").otherwise("completed").alias("status"), total.alias("items_planned"), "items_succeeded",
        (total - F.col("items_succeeded") - F.col("items_skipped")).alias("items_failed"), "items_skipped", F.array_join(F.coalesce("fingerprints", F.array().cast("array<string>")), ",").alias("fingerprints"),
    )


def next_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("day").agg((F.max("n") + 1).alias("n"))
