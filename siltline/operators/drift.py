"""Alerts per domain from two windows of score rows, and hosts whose extraction rots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.config import Drift
from siltline.operators.quantiles import histogram, medians, medians_of
from siltline.sources.contracts import overwrite_days

WINDOW = ("words", "extractiveness", "hhem")


def _side_by_side(found: DataFrame) -> DataFrame:
    now, before = (found.where(F.col("window") == name).select("domain", *[F.col(c).alias(f"{c}_{name}") for c in WINDOW]) for name in ("now", "before"))
    return now.join(before, "domain")


def by_domain(recent: DataFrame, baseline: DataFrame) -> DataFrame:
    """Exact medians of both windows, side by side, of the domains that are in both; one histogram serves both."""
    marked = [rows.select("domain", *WINDOW, F.lit(name).alias("window")) for rows, name in ((recent, "now"), (baseline, "before"))]
    return _side_by_side(medians(marked[0].unionByName(marked[1]), ["domain", "window"], list(WINDOW)))


def keep_days(rows: DataFrame, path: str, date: str = "date") -> None:
    """Writes a summary of each day in ``rows``, the counts of its values by domain; days that are there are replaced."""
    overwrite_days(histogram(rows, [date, "domain"], list(WINDOW)).withColumnRenamed(date, "date"), path, "date")


def kept_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("domain string, m string, v double, n long, date string").parquet(path)


def compare_days(summaries: DataFrame, recent: tuple[str, str], baseline: tuple[str, str], config: Drift = Drift()) -> DataFrame:
    """``compare`` of two spans of days (first and last) from kept summaries: no row is read again, and no other day."""
    spans = {"now": F.col("date").between(*recent), "before": F.col("date").between(*baseline)}
    parts = [summaries.where(on).groupBy("domain", "m", "v").agg(F.sum("n").alias("n")).withColumn("window", F.lit(name)) for name, on in spans.items()]
    return alerts(_side_by_side(medians_of(parts[0].unionByName(parts[1]), ["domain", "window"], list(WINDOW))), config)


def compare(recent: DataFrame, baseline: DataFrame, config: Drift = Drift()) -> DataFrame:
    """domain, alert, detail: every alert the two windows justify; a domain in one window alone is skipped."""
    return alerts(by_domain(recent, baseline), config)


def alerts(both: DataFrame, config: Drift = Drift()) -> DataFrame:
    """domain, alert, detail from the medians of two windows, side by side."""
    shorter = (F.col("words_before") > 0) & (F.col("words_now") < F.col("words_before") * (1 - config.word_count_drop))
    copying = F.col("extractiveness_now") - F.col("extractiveness_before") > config.extractiveness_rise
    held = F.col("hhem_now") >= F.col("hhem_before")
    alert = lambda on, name, detail: F.when(on, F.struct(F.lit(name).alias("alert"), detail.alias("detail")))
    even = lambda c, places=0: F.bround(c, places)  # noqa: E731  figures in words are rounded half to even
    words_now, words_before = even(F.col("words_now")), even(F.col("words_before"))
    found = F.array_compact(F.array(
        alert(shorter, "shorter_sources", F.format_string("median source fell from %.0f to %.0f words", words_before, words_now)),
        alert(copying, "more_copying", F.format_string("extractiveness rose from %.2f to %.2f", even(F.col("extractiveness_before"), 2), even(F.col("extractiveness_now"), 2))),
        alert(shorter & held, "scoring_chrome", F.format_string("sources shrank %.0f%% while faithfulness held at %.2f", even((1 - F.col("words_now") / F.col("words_before")) * 100), even(F.col("hhem_now"), 2))),
    ))
    return both.select("domain", F.explode(found).alias("x")).select("domain", "x.alert", "x.detail")


def failure_rate(succeeded: Column, attempted: Column) -> Column:
    return F.when(attempted <= 0, F.lit(0.0)).otherwise(1 - succeeded / attempted)


def rot(rows: DataFrame, host: str, ok: Column, config: Drift = Drift()) -> DataFrame:
    counts = rows.groupBy(host).agg(F.count_if(ok).alias("succeeded"), F.count("*").alias("attempted"))
    rate = failure_rate(F.col("succeeded"), F.col("attempted"))
    return counts.select(host, "succeeded", "attempted", F.bround(rate, 6).alias("failure_rate"), (rate > config.failure_rate_max).alias("rotting"))
