"""Figures of the published days: bands by date, a day's console, its notice, the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.operators.quantiles import medians

BANDS = ("high", "medium", "low")
STAGES = ("fetch_ms", "extract_ms", "summarize_ms", "score_ms")


def band_counts() -> list:
    return [F.count_if(F.col("band") == b).alias(b) for b in BANDS]


def bands_by_date(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date").agg(*band_counts())


def console_days(rows: DataFrame) -> DataFrame:
    """Per date: rows, exact medians of the stages (what is no number counts as 0), mean score, bands."""
    filled = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in STAGES})
    counted = rows.groupBy("date").agg(F.count("*").alias("items"), F.bround(F.avg("hhem"), 6).alias("mean_hhem"), *band_counts())
    return counted.join(medians(filled, ["date"], list(STAGES)), "date")


def worst_stage(days: DataFrame) -> DataFrame:
    return days.agg(F.greatest(F.lit(1.0), F.max(F.greatest(*STAGES))).alias("worst_ms"))


def day_notice(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Per day: bands with their zeros, low-confidence items, and how many later runs added something."""
    later = runs.where("n > 1 AND items_added > 0").groupBy("day").agg(F.count("*").alias("later_runs"))
    return items.groupBy("day").agg(F.count("*").alias("items"), *band_counts()).join(later, "day", "left").fillna(0, ["later_runs"])


def archive(items: DataFrame, counters: DataFrame) -> DataFrame:
    return items.groupBy("day").agg(F.count("*").alias("items")).join(counters.select("day", "partial"), "day")


def latest_date(days: DataFrame, column: str = "day") -> DataFrame:
    return days.agg(F.max(column).alias("latest"))


def paging(items: DataFrame, shown: int = 12) -> DataFrame:
    n = F.count("*")
    return items.groupBy("day").agg(F.least(n, F.lit(shown)).alias("shown"), F.greatest(n - shown, F.lit(0)).alias("remaining"))
