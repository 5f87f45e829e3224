"""Which visual an item gets: bars of one unit, a chain of steps, or none with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.config import Visuals
from siltline.functions.text import sanitize


def fact_menu(facts: Column) -> Column:
    return F.array_join(F.transform(facts, lambda f, i: F.concat_ws(" ", F.concat(i.cast("string"), F.lit(":")), f["raw"], f["unit"], F.lit("|"), f["context"])), "\n")


def with_units(points: Column, facts: Column) -> Column:
    """Points with their fact's unit and place; a point without a fact has no unit."""
    return F.transform(points, lambda p, i: F.struct(p["label"].alias("label"), p["fact_index"].alias("fact_index"), i.alias("place"), F.try_element_at(facts, p["fact_index"] + 1)["unit"].alias("unit")))


def same_unit_bars(points: Column, facts: Column) -> Column:
    """The largest group of points of one unit, in order; of equal groups the one that starts first."""
    marked = with_units(points, facts)
    units = F.array_distinct(F.transform(marked, lambda p: p["unit"]))
    groups = F.transform(units, lambda u, i: F.struct(F.size(F.filter(marked, lambda p: p["unit"].eqNullSafe(u))).alias("n"), (-i).alias("first"), u.alias("unit")))
    unit = F.array_max(groups)["unit"]
    return F.filter(marked, lambda p: p["unit"].eqNullSafe(unit))


def common_unit(points: Column, facts: Column) -> Column:
    units = F.array_distinct(F.transform(with_units(points, facts), lambda p: p["unit"]))
    return F.when(F.size(units) == 1, F.element_at(units, 1))


def diagram_spec(steps: Column, caption: Column) -> Column:
    label = lambda s: F.replace(F.substring(sanitize(s), 1, 60), F.lit('"'), F.lit("'"))
    nodes = F.transform(steps, lambda s, i: F.concat(F.lit("    n"), i.cast("string"), F.lit('["'), label(s), F.lit('"]')))
    edges = F.transform(F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))), lambda s, i: F.concat(F.lit("    n"), i.cast("string"), F.lit(" --> n"), (i + 1).cast("string")))
    head = F.when(F.coalesce(caption, F.lit("")) == "", F.array(F.lit("flowchart TD"))).otherwise(F.array(F.concat(F.lit("%% "), F.substring(sanitize(caption), 1, 120)), F.lit("flowchart TD")))
    return F.array_join(F.concat(head, nodes, edges), "\n")


def alt_text(kind: Column, bars: Column, facts: Column, steps: Column) -> Column:
    bar = F.transform(bars, lambda p: F.trim(F.concat_ws(" ", F.substring(sanitize(p["label"]), 1, 40), F.try_element_at(facts, p["fact_index"] + 1)["raw"], p["unit"])))
    chain = F.array_join(F.transform(steps, lambda s: F.substring(sanitize(s), 1, 60)), " then ")
    chart = F.concat(F.lit("Bar chart. "), F.array_join(bar, "; "), F.lit("."))
    return F.substring(F.when(kind == "chart", chart).otherwise(F.concat(F.lit("Flow diagram. "), chain, F.lit("."))), 1, 300)


def to_routes(rows: DataFrame, visuals: Visuals = Visuals(), enabled: tuple[str, ...] = ("chart", "diagram")) -> DataFrame:
    """rows has summary_status, finish_reason, shape_ok, kind, points, steps, caption, reason and facts.

    Adds kind, rationale, spec, spec_format and alt_text. Every refusal, in this order, ends in none.
    """
    rows = rows.withColumn("bars", same_unit_bars(F.col("points"), F.col("facts")))
    n, steps = F.size("bars"), F.size("steps")
    is_chart = F.col("kind") == "chart"
    outside = F.exists("points", lambda p: (p["fact_index"] >= F.size("facts")) | (p["fact_index"] < 0))
    refusal = (
        F.when(F.col("summary_status") != "ok", "the item has no summary, so there is nothing to illustrate")
        .when(F.col("finish_reason") == "length", "the routing reply was cut off by the output budget")
        .when(~F.coalesce("shape_ok", F.lit(False)), "the routing reply did not hold its shape")
        .when(F.col("kind") == "none", F.col("reason"))
        .when(~F.col("kind").isin(*enabled), F.concat("kind", F.lit(" has no renderer switched on")))
        .when(is_chart & outside, "the chart pointed at a quantity the article does not contain")
        .when(is_chart & ~n.between(visuals.min_points, visuals.max_points), F.format_string("%d of %d bars measure the same thing, which is outside the publishable range", n, F.size("points")))
        .when(~is_chart & ~steps.between(visuals.min_steps, visuals.max_steps), F.format_string("%d steps is outside the publishable range", steps))
    )
    rows = rows.withColumn("refusal", refusal)
    shown = F.col("refusal").isNull()
    caption = F.when(n == F.size("points"), F.col("caption")).otherwise("")  # words about five bars are false of three
    values = F.transform("bars", lambda p: F.struct(p["label"].alias("label"), F.try_element_at(F.col("facts"), p["fact_index"] + 1)["value"].cast("double").alias("value")))
    chart = F.to_json(F.struct(caption.alias("caption"), F.element_at("bars", 1)["unit"].alias("unit"), values.alias("values")))
    spec = F.when(is_chart, chart).otherwise(diagram_spec(F.col("steps"), F.col("caption")))
    alt = alt_text(F.col("kind"), F.col("bars"), F.col("facts"), F.col("steps"))
    kind = F.when(shown, F.col("kind")).otherwise("none")
    return rows.withColumns({
        "spec": F.when(shown, spec), "spec_format": F.when(shown, F.when(is_chart, "vega_lite").otherwise("mermaid")), "alt_text": F.when(shown, alt), "rationale": F.substring(F.coalesce("refusal", sanitize(F.col("reason"))), 1, 200),
    }).withColumn("kind", kind).drop("refusal", "bars")
