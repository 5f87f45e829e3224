"""A day's items from what the stages left: joins with their defaults, visuals, vectors, reading state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltline.functions import vectors as V
from siltline.operators import models

KEY = ["day", "item_id"]


def joined(plan: DataFrame, articles: DataFrame, summaries: DataFrame, evals: DataFrame, routes: DataFrame) -> DataFrame:
    """Planned items that have an article and a summary; score and route where there are any. All have day and item_id."""
    return plan.join(articles, KEY).join(summaries, KEY).join(evals, KEY, "left").join(routes, KEY, "left")


def band_or_fallback(band: Column, counterweight: Column) -> Column:
    """The scored band; the one from counterweights where no score row exists."""
    return F.coalesce(band, counterweight)


def with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """source_name and source_kind by source_id: the id itself and "reporting" where the source is not listed."""
    names = sources.select("source_id", "source_name", "source_kind")
    rows = items.join(names, "source_id", "left")
    return rows.withColumns({"source_name": F.coalesce("source_name", "source_id"), "source_kind": F.coalesce("source_kind", F.lit("reporting"))})


def with_vertical(items: DataFrame, verticals: DataFrame) -> DataFrame:
    rows = items.join(verticals.select("vertical", "display_name"), "vertical", "left")
    return rows.withColumn("display_name", F.coalesce("display_name", "vertical"))


def visual(kind: Column, path: Column, alt_text: Column, state: Column) -> Column:
    """Struct of a visual, null without one."""
    return F.when(F.coalesce(kind, F.lit("none")) != "none", F.struct(kind.alias("kind"), path.alias("path"), alt_text.alias("alt_text"), state.alias("state")))


def digest_items(rows: DataFrame, run_n: int | Column) -> DataFrame:
    """The published item: all its fields in one projection. rows is joined() with source, kind, band and route columns.

    Lists that are missing are empty, a missing summary is the empty text, updated_at is null when an item is new.
    """
    none = F.array().cast("array<string>")
    run = run_n if isinstance(run_n, Column) else F.lit(run_n)
    lists = [F.coalesce(F.col(c), none).alias(c) for c in ("key_points", "lenses", "events", "entities")]
    return rows.select(
        "day", "item_id", "vertical", title_or(F.col("title")).alias("title"), F.col("canonical_url").alias("source_url"), "source_id", "source_name", "source_kind", "published_at", F.coalesce("summary", F.lit("")).alias("summary"), *lists,
        "band", F.coalesce("truncated", F.lit(False)).alias("truncated"), visual(F.col("kind"), F.col("asset_path"), F.col("alt_text"), F.col("visual_state")).alias("visual"), run.alias("introduced_by_run"), F.lit(None).cast("string").alias("updated_at"),
    )


def title_or(title: Column, fallback: str = "Untitled item") -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit(fallback))


def text_for(title: Column, summary: Column) -> Column:
    """What an encoder reads of an item."""
    return F.concat(title, F.lit(". "), summary)


def embedded(items: DataFrame, text: Column, load: models.Load, dimensions: int) -> DataFrame:
    """day, item_id and the quantised vector of each item; the encoder is loaded once per task and sees batches of texts.

    A day is published whether or not it can be searched: where the encoder fails or gives another
    width for any of its items, the day has no vectors at all.
    """
    rows = items.select(*KEY, models.encoder(load, dimensions)(text).alias("v"))
    failed = F.max(F.col("v").isNull()).over(Window.partitionBy("day"))
    return rows.withColumn("failed", failed).where("NOT failed").select(*KEY, V.quantise(F.col("v")).alias("vector"))


def hide_read(items: DataFrame, read: DataFrame, hide: bool) -> DataFrame:
    """Items without those read, if asked for; their order does not change."""
    return items.join(read.select(*KEY).distinct(), KEY, "left_anti") if hide else items


def day_of(items: DataFrame, date: str) -> DataFrame:
    """One day's rows; on a table partitioned by day only that partition is read."""
    return items.where(F.col("day") == date)


def of_vertical(items: DataFrame, vertical: str) -> DataFrame:
    return items.where(F.col("vertical") == vertical)


def lead_words(text: Column, n: int = 150) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def link_limit(links: DataFrame, n: int) -> DataFrame:
    """The first n different links of each feed (columns feed, link, position)."""
    first = links.groupBy("feed", "link").agg(F.min("position").alias("position"))
    nth = F.row_number().over(Window.partitionBy("feed").orderBy("position"))
    return first.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")
