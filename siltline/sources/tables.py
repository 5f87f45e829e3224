"""The given tables in the shapes that the operators read. Nothing is made up: every row follows from a table's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.functions import urls as U

STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as links that feeds offered: one per day, vertical, story and source, the earliest kept."""
    story = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("event_type").alias("vertical"),
        F.concat(F.lit("https://story.example/"), "event_type", F.lit("/"), story).alias("canonical_url"),
        F.col("user_id").cast("string").alias("source_id"),
        (F.col("user_id") % 3 + 1).cast("int").alias("tier"),
        F.date_format("ts", STAMP).alias("published_at"),
    )
    one = rows.groupBy("day", "vertical", "canonical_url", "source_id", "tier").agg(F.min("published_at").alias("published_at"))
    return one.withColumn("url_key", U.url_key(F.col("canonical_url")))


def verticals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event type: cap and floor of sources."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("vertical")).distinct()
    return rows.select("vertical", F.initcap("vertical").alias("display_name"), F.when(F.col("vertical") == "click", 5).otherwise(3).alias("daily_cap"), F.lit(5).alias("min_feeds"))


def every_tenth(rows: DataFrame, last: int) -> DataFrame:
    """Keys of stories whose number ends in ``last``: a watchlist or a front page."""
    return rows.where(F.col("canonical_url").endswith(str(last))).select("url_key").distinct()


def spread(rows: DataFrame, scan: DataFrame) -> DataFrame:
    """``rows`` over all cores where a table of few splits would keep most of them idle; else as they are, unshuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if scan.rdd.getNumPartitions() < cores else rows


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document and a summary that holds some of it: its 2nd, 4th and 6th sentence and the next document's first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.col("text").alias("source_text"))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.element_at(T.sentences(F.col("source_text"), 1), 1).alias("next"))
    own = F.col("own")  # a column of its own: inside the filter below each use would cut the text again
    picked = F.filter(F.array(F.try_element_at(own, F.lit(2)), F.try_element_at(own, F.lit(4)), F.try_element_at(own, F.lit(6)), F.col("next")), lambda s: s.isNotNull())
    rows = docs.join(following, "doc_id", "left").withColumn("own", F.slice(T.sentences(F.col("source_text"), 6), 1, 6))
    return spread(rows.withColumn("summary", F.array_join(picked, " ")).drop("next", "own"), docs)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as score rows: the quality label stands for the score, the id gives the day."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    labels = table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id")
    return rows.select(
        "doc_id", "source", "lang", day(F.col("doc_id")).alias("date"), (F.col("quality") * 0.45 + F.col("doc_id") % 10 * 0.05).alias("hhem"), F.col("toxic"), F.col("n_chars"), "text",
        (F.col("n_chars") % 997).alias("fetch_ms"), (F.col("n_chars") % 499).alias("extract_ms"), (F.col("n_chars") % 1999).alias("summarize_ms"), (F.col("n_chars") % 89).alias("score_ms"),
    )


def day(key: Column) -> Column:
    return F.format_string("2026-08-%02d", key % 28 + 1)
