"""Integrity rules as rows: (table, key, rule) for every row that breaks one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATE, ITEM, SHA, SLUG = r"^\d{4}-\d{2}-\d{2}$", r"^[a-z0-9_-]+-\d{2,}$", r"^[0-9a-f]{64}$", r"^[a-z0-9]+(?:[-_][a-z0-9]+)*$"


def broken(rows: DataFrame, table: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """A rule holds where its condition is true; false and null break it."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.explode(found).alias("rule"))


def repeated(rows: DataFrame, table: str, columns: list[str], rule: str) -> DataFrame:
    """Keys that more than one row has."""
    twice = rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return twice.select(F.lit(table).alias("table"), F.concat_ws("/", *columns).alias("key"), F.lit(rule).alias("rule"))


def violations(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def distinct_values(column: str) -> Column:
    values = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return F.size(values) == F.size(F.array_distinct(values))


def identity_rules() -> dict[str, Column]:
    return {
        "item id is addressed by its vertical": F.col("item_id").startswith(F.concat("vertical", F.lit("-"))) & F.col("item_id").rlike(ITEM),
        "key is the digest of the address": F.col("url_key") == F.sha2("canonical_url", 256),
    }


def check_plan(items: DataFrame, vertical_plans: DataFrame | None = None) -> DataFrame:
    """One pass: the rows of a day stay together for all windows; a day's list is bounded by its caps.

    vertical_plans, if given, has day, vertical and planned, and must agree with the items.
    """
    in_list = Window.partitionBy("day", "vertical").orderBy("ordinal")
    rows = items.repartition("day").withColumns({
        "k": F.concat_ws("/", "day", "item_id"), "same_story": F.count("*").over(Window.partitionBy("day", "url_key")), "same_id": F.count("*").over(Window.partitionBy("day", "item_id")), "before": F.lag("rank_score").over(in_list), "place": F.row_number().over(in_list),
    })
    found = broken(rows, "plan", "k", {
        "date is a date": F.col("day").rlike(DATE), **identity_rules(), "tier is known": F.col("tier").isin(1, 2, 3), "carried by at least one source": F.col("carried_by") >= 1, "score is not negative": F.col("rank_score") >= 0,
        "stories are distinct": F.col("same_story") == 1, "item ids are distinct": F.col("same_id") == 1, "scores do not rise": F.col("before").isNull() | (F.col("rank_score") <= F.col("before")), "numbers have no gaps": F.col("place") == F.col("ordinal"),
    })
    if vertical_plans is None:
        return found
    counted = items.groupBy("day", "vertical").agg(F.count("*").alias("found"))
    both = vertical_plans.join(counted, ["day", "vertical"], "full").withColumn("k", F.concat_ws("/", "day", "vertical"))
    return violations(found, broken(both, "plan", "k", {"planned is what is listed": F.coalesce("planned", F.lit(-1)) == F.coalesce("found", F.lit(0))}))


def check_vertical_plans(rows: DataFrame) -> DataFrame:
    return broken(rows.withColumn("k", F.concat_ws("/", "day", "vertical")), "vertical plan", "k", {"planned at most what was considered": F.col("planned") <= F.col("considered"), "none planned below the floor": ~F.col("below_feed_floor") | (F.col("planned") == 0)})


def check_articles(rows: DataFrame, key: str) -> DataFrame:
    """Rules of an article's state; those of its identity and tags where the rows have these columns."""
    ok = F.col("status") == "ok"
    rules = {
        "ok has text and title": ~ok | (F.col("text").isNotNull() & (F.col("text") != "") & F.col("title").isNotNull()),
        "ok has no failure": ~ok | F.col("failure_detail").isNull(),
        "failed has a reason": ok | F.col("failure_detail").isNotNull(),
        "truncated says where": F.col("truncated") == F.col("truncated_at_tokens").isNotNull(),
    }
    if {"item_id", "vertical", "url_key", "canonical_url"} <= set(rows.columns):
        rules |= identity_rules()
    rules |= {f"{c} are distinct": distinct_values(c) for c in ("lenses", "events") if c in rows.columns}
    return broken(rows, "article", key, rules)


def check_summaries(rows: DataFrame, key: str, rebuilt: Column) -> DataFrame:
    """``rebuilt`` is the digest of the row's words, worked out anew."""
    ok, some = F.col("status") == "ok", (F.length("summary") > 0) & (F.size("key_points") > 0)
    return broken(rows, "summary", key, {"digest is rebuilt from the words": F.col("output_digest") == rebuilt, "ok has words and points": ~ok | F.coalesce(some, F.lit(False)), "ok has no failure": ~ok | F.col("failure_detail").isNull(), "failed has a reason": ok | F.col("failure_detail").isNotNull()})


def check_eval(rows: DataFrame, key: str) -> DataFrame:
    share = lambda c: F.col(c).between(0, 1)
    return broken(rows, "eval", key, {
        "delta is rebuilt": F.abs(F.col("hhem_delta") - F.bround(F.col("hhem") - F.col("hhem_full"), 6)) <= 1e-9,
        "shares lie in 0..1": share("coverage") & share("extractiveness") & share("verbatim_run"),
        "band is known": F.col("band").isin("high", "medium", "low"),
        "an invented number is low": (F.col("unsupported_numbers") == 0) | (F.col("band") == "low"),
    })


def check_runs(rows: DataFrame) -> DataFrame:
    """Runs of days: day, n, run_id, status, completed_at and counts. A day has few runs."""
    own = rows.withColumns({"k": F.concat_ws("/", "day", "n"), "place": F.row_number().over(Window.partitionBy("day").orderBy("n"))})
    return broken(own, "run", "k", {
        "counts add up": F.col("items_succeeded") + F.col("items_failed") + F.col("items_skipped") == F.col("items_planned"), "failed is not negative": F.col("items_failed") >= 0, "runs have no gaps": F.col("place") == F.col("n"),
        "run id is the day and number": F.col("run_id") == F.concat_ws("-", "day", "n"), "completed says when": (F.col("status") != "completed") | F.col("completed_at").isNotNull(),
    })


def check_run_verticals(rows: DataFrame) -> DataFrame:
    return broken(rows.withColumn("k", F.concat_ws("/", "day", "n", "vertical")), "run", "k", {"published at most what was planned": F.col("published") <= F.col("planned")})


def check_lifecycle(rows: DataFrame, table: str, key: str) -> DataFrame:
    return broken(rows, table, key, {"retired has a date, others none": (F.col("status") == "retired") == F.col("retired_on").isNotNull()})


def check_sources(rows: DataFrame) -> DataFrame:
    return violations(check_lifecycle(rows, "feed", "id"), repeated(rows, "feed", ["id"], "feed ids are distinct"), repeated(rows, "feed", ["url"], "feed addresses are distinct"))


def check_watchlist(entities: DataFrame) -> DataFrame:
    """Entities: id, cik, feeds (ids), status, retired_on."""
    feeds = entities.select(F.explode("feeds").alias("feed"))
    ciks = entities.where("cik IS NOT NULL")
    return violations(
        repeated(entities, "entity", ["id"], "entity ids are distinct"), repeated(feeds, "entity feed", ["feed"], "feed ids are distinct across entities"), repeated(ciks, "entity", ["cik"], "a CIK names one entity"),
        check_lifecycle(entities, "entity", "id"),
    )


def check_vocabulary(labels: DataFrame, known: DataFrame, table: str) -> DataFrame:
    """Every known id is labelled once and no other is; both have ``id``."""
    times = labels.groupBy("id").agg(F.count("*").alias("times"))
    rows = known.select("id").distinct().withColumn("known", F.lit(True)).join(times, "id", "full")
    return broken(rows, table, "id", {"it is in the vocabulary": F.col("known"), "it is labelled once": F.coalesce("times", F.lit(0)) == 1})


def check_edgar(policies: DataFrame, key: str) -> DataFrame:
    return broken(policies, "policy", key, {"a contact is declared where it is enabled": ~F.col("enabled") | F.col("contact_email").isNotNull(), "one to ten requests a second": F.col("requests_per_second").between(1, 10)})


def check_routes(rows: DataFrame, key: str) -> DataFrame:
    """A kind, its format, its spec and the state of its picture agree."""
    none, wanted = F.col("kind") == "none", F.when(F.col("kind") == "chart", "vega_lite").when(F.col("kind") == "diagram", "mermaid").otherwise("image_prompt")
    state = F.col("visual_state")
    return broken(rows, "route", key, {
        "none has no spec": ~none | (F.col("spec").isNull() & F.col("spec_format").isNull()), "none has no picture": ~none | (state == "absent"), "format is that of the kind": none | F.col("spec_format").eqNullSafe(wanted), "a kind has a spec": none | F.coalesce(F.col("spec") != "", F.lit(False)),
        "a path is there if it was drawn": (state == "rendered") == F.col("asset_path").isNotNull(), "a failed drawing says why": (state == "render_failed") == F.col("failure_detail").isNotNull(),
    })


def check_days(days: DataFrame, items: DataFrame, runs: DataFrame, verticals: DataFrame) -> DataFrame:
    """Published days: day, partial, items_planned, items_failed; items with position, vertical and introduced_by_run;
    runs with n and items_added; verticals with count. A day's items are bounded by its caps."""
    by_day = Window.partitionBy("day")
    in_order = by_day.orderBy("position")
    listed = verticals.select("day", "vertical", F.lit(True).alias("listed")).distinct()
    known = runs.groupBy("day").agg(F.max("n").alias("last"))
    rows = items.join(listed, ["day", "vertical"], "left").join(known, "day", "left").repartition("day")
    rows = rows.withColumns({"k": F.concat_ws("/", "day", "item_id"), "same": F.count("*").over(Window.partitionBy("day", "item_id")), "before": F.lag("introduced_by_run").over(in_order)})
    per_run = items.groupBy("day", F.col("introduced_by_run").alias("n")).agg(F.count("*").alias("found"))
    numbered = runs.withColumn("place", F.row_number().over(by_day.orderBy("n"))).join(per_run, ["day", "n"], "left").withColumn("k", F.concat_ws("/", "day", "n"))
    per_vertical = items.groupBy("day", "vertical").agg(F.count("*").alias("found"))
    named = verticals.withColumn("times", F.count("*").over(Window.partitionBy("day", "vertical"))).join(per_vertical, ["day", "vertical"], "left").withColumn("k", F.concat_ws("/", "day", "vertical"))
    whole = days.join(items.groupBy("day").agg(F.count("*").alias("found")), "day", "left")
    return violations(
        broken(rows, "day item", "k", {"item ids are distinct": F.col("same") == 1, "later runs append": F.col("before").isNull() | (F.col("introduced_by_run") >= F.col("before")), "its run is recorded": F.col("introduced_by_run") <= F.col("last"), "its vertical is listed": F.col("listed"), "addressed by its vertical": F.col("item_id").startswith(F.concat("vertical", F.lit("-")))}),
        broken(numbered, "day run", "k", {"runs have no gaps": F.col("place") == F.col("n"), "added is what it introduced": F.col("items_added") == F.coalesce("found", F.lit(0))}),
        broken(named, "day vertical", "k", {"verticals are distinct": F.col("times") == 1, "count is what is there": F.col("count") == F.coalesce("found", F.lit(0))}),
        broken(whole, "day", "day", {"partial if some failed": F.col("partial") == (F.col("items_failed") > 0), "published and failed fit the plan": F.coalesce("found", F.lit(0)) + F.col("items_failed") <= F.col("items_planned")}),
    )


def check_visuals(rows: DataFrame, key: str) -> DataFrame:
    return broken(rows, "visual", key, {"a path is there if it was drawn": (F.col("state") == "rendered") == F.col("path").isNotNull()})


def check_validation(rows: DataFrame) -> DataFrame:
    return broken(rows, "validation", "model_id", {"a switch does not select the model in use": ~((F.col("verdict") == "switch_and_pause") & F.col("is_incumbent") & F.col("selected"))})


def check_fingerprints(rows: DataFrame, key: str, rebuilt: Column) -> DataFrame:
    return broken(rows, "fingerprint", key, {"fingerprint is rebuilt from its inputs": F.col("pipeline_fingerprint") == rebuilt, "it is a digest": F.col("pipeline_fingerprint").rlike(SHA)})
