"""From candidates to a ranked work list: merge, score, order, caps, numbering, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltline.config import Collect

GROUP = ["day", "vertical"]


def live_feeds(feeds: DataFrame, vertical: str | None = None) -> DataFrame:
    live = feeds.where((F.col("status") == "active") & F.col("retired_on").isNull())
    return live if vertical is None else live.where(F.col("vertical") == vertical)


def flagged(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a flag whether their url_key is among ``keys`` (distinct)."""
    return rows.join(keys.select("url_key", F.lit(True).alias(name)), "url_key", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def stories(candidates: DataFrame) -> DataFrame:
    """One row per day, vertical and story: how many sources carry it, and the one of best tier and smallest id."""
    first = F.min(F.struct("tier", "source_id", "published_at")).alias("first")
    merged = candidates.groupBy(*GROUP, "url_key", "canonical_url").agg(F.count("*").alias("carried_by"), first)
    return merged.select(*GROUP, "url_key", "canonical_url", "carried_by", "first.*")


def scored(stories_: DataFrame, watchlist: DataFrame, front_page: DataFrame, config: Collect = Collect()) -> DataFrame:
    w = config.tier_weights
    authority = F.when(F.col("tier") == 1, w.institution).when(F.col("tier") == 2, w.trade_press).otherwise(w.community)
    reach = 1.0 + config.repetition_weight * (F.col("carried_by") - 1)
    rows = flagged(flagged(stories_, watchlist, "watchlist_hit"), front_page, "on_front_page")
    bonus = F.when(F.col("watchlist_hit"), config.watchlist_bonus).otherwise(0.0) + F.when(F.col("on_front_page"), config.front_page_bonus).otherwise(0.0)
    return rows.withColumn("rank_score", F.bround(authority * reach + bonus, 6))


def planned(scored_: DataFrame, verticals: DataFrame, live: DataFrame, config: Collect = Collect()) -> DataFrame:
    """The day's items per vertical: no source more than its share, then the cap; none below the floor.

    A story that its source's share shuts out takes none of the cap, and the share depends only on
    the order within the source; so two row numbers give what a greedy pass gives.
    """
    order = [F.desc("rank_score"), F.desc(F.coalesce("published_at", F.lit(""))), "canonical_url"]
    open_ = verticals.join(live, "vertical", "left").where(F.coalesce("live_feeds", F.lit(0)) >= F.col("min_feeds"))
    rows = scored_.join(open_.select("vertical", "daily_cap"), "vertical")
    rows = rows.withColumn("of_source", F.row_number().over(Window.partitionBy(*GROUP, "source_id").orderBy(*order))).where(F.col("of_source") <= config.max_per_source)
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order))).where(F.col("ordinal") <= F.col("daily_cap"))
    item_id = F.format_string("%s-%02d", "vertical", "ordinal")
    return rows.select("day", "vertical", "ordinal", item_id.alias("item_id"), "url_key", "canonical_url", "source_id", "tier", "published_at", "carried_by", "watchlist_hit", "on_front_page", "rank_score")


def vertical_plans(stories_: DataFrame, items: DataFrame, verticals: DataFrame, live: DataFrame) -> DataFrame:
    """Per day and vertical: stories considered, items planned, live feeds, whether below the floor."""
    days = stories_.select("day").distinct().crossJoin(F.broadcast(verticals))  # a few verticals for each day
    seen = stories_.groupBy(*GROUP).agg(F.count("*").alias("considered"))
    took = items.groupBy(*GROUP).agg(F.count("*").alias("planned"))
    rows = days.join(live, "vertical", "left").join(seen, GROUP, "left").join(took, GROUP, "left").fillna(0, ["considered", "planned", "live_feeds"])
    return rows.select("day", "vertical", "considered", "planned", "live_feeds", (F.col("live_feeds") < F.col("min_feeds")).alias("below_feed_floor"))


def shard_of(items: DataFrame, shards: int) -> DataFrame:
    """Round robin within the day, in plan order."""
    place = F.row_number().over(Window.partitionBy("day").orderBy("vertical", "ordinal"))
    return items.select("day", "item_id", ((place - 1) % shards).cast("int").alias("shard"))


def visual_ordinals(items: DataFrame) -> DataFrame:
    """Running number of items with a visual, per vertical in plan order; null without one."""
    has = F.col("kind") != "none"
    count = F.count(F.when(has, 1)).over(Window.partitionBy(*GROUP).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return items.withColumn("visual_ordinal", F.when(has, count))
