"""Whether measured scores confirm the model in use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.config import Evaluation


def measured(rows: DataFrame) -> DataFrame:
    """Per model: mean score (0 without any) and how many articles were scored."""
    return rows.groupBy("model_id", "leaderboard_hhem").agg(F.coalesce(F.avg("hhem"), F.lit(0.0)).alias("measured_hhem"), F.count("hhem").cast("int").alias("articles"))


def decide(measurements: DataFrame, incumbent: str, config: Evaluation = Evaluation()) -> DataFrame:
    """One row: verdict, winner, detail. Too few articles, a clear challenger, a drop, or confirmed, in this order.

    Among challengers of one best score the one listed first (column ``position``) stands.
    """
    own = measurements.where(F.col("model_id") == incumbent)
    others = measurements.where((F.col("model_id") != incumbent) & (F.col("articles") >= config.validation_articles))
    best = others.agg(F.max(F.struct(F.col("measured_hhem").alias("score"), (-F.col("position")).alias("place"), F.col("model_id").alias("name"))).alias("best"))
    rows = own.crossJoin(best)  # one row and one row
    gain, drop = F.col("best.score") - F.col("measured_hhem"), F.col("leaderboard_hhem") - F.col("measured_hhem")
    few, switch, fell = F.col("articles") < config.validation_articles, F.coalesce(gain >= config.validation_switch_margin, F.lit(False)), drop > config.validation_drop_max
    verdict = F.when(few, "rescore_candidates").when(switch, "switch_and_pause").when(fell, "rescore_candidates").otherwise("confirmed")
    detail = (
        F.when(few, F.format_string(f"the incumbent was scored on %d articles, below the {config.validation_articles} this gate requires", "articles"))
        .when(switch, F.format_string("%s scores %.3f above %s on our own corpus", "best.name", gain, "model_id"))
        .when(fell, F.format_string("%s measured %.3f below its leaderboard number", "model_id", drop))
        .otherwise(F.format_string("%s measured %.3f against a leaderboard %.3f", "model_id", "measured_hhem", "leaderboard_hhem"))
    )
    winner = F.when(~few & switch, F.col("best.name")).otherwise(F.col("model_id"))
    return rows.select(verdict.alias("verdict"), winner.alias("winner"), detail.alias("detail"))


def to_rows(measurements: DataFrame, decision: DataFrame, incumbent: str) -> DataFrame:
    """Every candidate with the verdict: the ledger keeps the losers too."""
    return measurements.crossJoin(F.broadcast(decision)).select(  # one row
        "model_id", (F.col("model_id") == incumbent).alias("is_incumbent"), (F.col("model_id") == F.col("winner")).alias("selected"), "leaderboard_hhem", F.bround("measured_hhem", 6).alias("measured_hhem"), "articles", "verdict",
    )
