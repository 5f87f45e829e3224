"""What is measured about a summary against its source, and the bands drawn from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.config import Evaluation
from siltline.functions import text as T


def band(score: Column, unsupported: Column, config: Evaluation = Evaluation()) -> Column:
    return F.when(unsupported > 0, "low").when(score >= config.band_high_min, "high").when(score >= config.band_medium_min, "medium").otherwise("low")


def counterweight_band(summary: Column, source: Column, config: Evaluation = Evaluation()) -> Column:
    """The band where no score exists; never high."""
    low = (T.unsupported_numbers(summary, source) > 0) | (T.lead_coverage(summary, source) < config.lead_coverage_floor) | T.hedge_dropped(summary, source)
    return F.when(low, "low").otherwise("medium")


def eval_rows(pairs: DataFrame, score: Column, score_full: Column, config: Evaluation = Evaluation()) -> DataFrame:
    """One row of measures per pair of source_text and summary; other columns are kept."""
    s, d = F.col("summary"), F.col("source_text")
    kept = [c for c in pairs.columns if c not in ("summary", "source_text")]
    rows = pairs.select(*kept, score.alias("hhem"), score_full.alias("hhem_full"), T.measures(s, d).alias("m"), F.size(T.split_words(d)).alias("source_seen_word_count")).select("*", "m.*").drop("m")
    delta = F.bround(F.col("hhem") - F.col("hhem_full"), 6)
    return rows.withColumns({"hhem_delta": delta, "truncation_flagged": delta > config.truncation_gap_max, "band": band(F.col("hhem"), F.col("unsupported_numbers"), config)})


#: The ledger's columns that identify a row, and those that say how it was made.
IDENTITY = ("version", "date", "run_id", "item_id", "url_key", "source_url", "title", "vertical", "model_id", "attempt")
MADE = ("pipeline_fingerprint", "output_digest", "determinism_violation", "scorer_version", "scored_at", "score_ms")


def ledger_rows(pairs: DataFrame, score: Column, score_full: Column, config: Evaluation = Evaluation()) -> DataFrame:
    """The ledger's whole row: identity, the measures of eval_rows, and how it was made.

    pairs has source_text (the whole article), summary, source_seen_word_count (words of what the model saw)
    and the columns of IDENTITY and MADE; of these a missing title is "Untitled item", flags are false and
    score_ms 0 where null.
    """
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("extraction_suspect", "determinism_violation")}
    rows = pairs.withColumns({"title": F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled item")), "score_ms": F.coalesce("score_ms", F.lit(0)), "seen": F.col("source_seen_word_count"), **flags}).drop("source_seen_word_count")
    made = eval_rows(rows, score, score_full, config)
    names = [*IDENTITY, "hhem", "hhem_full", "hhem_delta", "truncation_flagged", "coverage", "compression", "extractiveness", "verbatim_run", "unsupported_numbers", "hedge_dropped", "extraction_suspect", "band", "source_word_count", "source_seen_word_count", "summary_word_count", *MADE]
    return made.withColumn("source_seen_word_count", F.col("seen")).select(*names)


def score_over_chunks(pairs: DataFrame, scorer: Callable[[Column, Column], Column], key: str) -> DataFrame:
    """The largest score of a source's windows against the summary; 0 without any. Windows spread a long source over tasks."""
    windows = pairs.select(key, "summary", F.explode_outer(T.chunks(F.col("source_text"))).alias("premise"))
    return windows.groupBy(key).agg(F.coalesce(F.max(scorer(F.col("premise"), F.col("summary"))), F.lit(0.0)).alias("score"))


def dual_score(scorer: Callable[[Column, Column], Column], summary: Column, seen: Column, full: Column) -> tuple[Column, Column]:
    """Scores of a summary against the text that the model saw and against the whole one; equal texts are scored once."""
    first = scorer(seen, summary)
    return first, F.when(seen == full, first).otherwise(scorer(F.when(seen != full, full), summary))


def overlap_scorer(premise: Column, hypothesis: Column) -> Column:
    """A stand-in for a faithfulness model: share of the hypothesis's different tokens in the premise."""
    own = F.array_distinct(T.tokens(hypothesis))
    return T.ratio(F.size(F.array_intersect(own, T.tokens(premise))), F.size(own))


def band_edges(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.coalesce(F.min(column), F.lit(0.0)).alias("low"), F.coalesce(F.max(column), F.lit(0.0)).alias("high"))
