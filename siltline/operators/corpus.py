"""Shape of a corpus, boilerplate, and the time that articles of each length take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.operators.quantiles import running


def nearest_rank(ordered: Column, fraction: float) -> Column:
    """The value at round_half_even(f * (n - 1)) of a sorted array; 0 if it is empty."""
    return F.when(F.size(ordered) == 0, F.lit(0)).otherwise(F.element_at(ordered, (F.bround(F.lit(fraction) * (F.size(ordered) - 1), 0) + 1).cast("int")))


def percentiles(rows: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles from the histogram of values: places are found by running counts, no value list is gathered."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    places = running(counts, [], "v").crossJoin(F.broadcast(total))  # one row
    picks = []
    for name, f in fractions.items():
        place = F.least(F.bround(F.lit(f) * (F.col("total") - 1), 0), F.col("total") - 1)
        picks.append(F.coalesce(F.min(F.when(F.col("upto") > place, F.col("v"))), F.lit(0)).alias(name))
    return places.agg(*picks)


def corpus_shape(rows: DataFrame, status: str, words: str, edges: tuple[int, int] = (600, 2000)) -> DataFrame:
    """One row: counts, mean, sample deviation, percentiles, largest, and each bucket's number and share."""
    ok = rows.where(F.col(status) == "ok").select(F.col(words).cast("int").alias("w"))
    n = F.count("w")
    bucket = F.when(F.col("w") < edges[0], "short").when(F.col("w") < edges[1], "medium").otherwise("long")
    aggs = [n.alias("n_extracted"), F.bround(F.coalesce(F.avg("w"), F.lit(0.0)), 1).alias("mean_words"), F.bround(F.coalesce(F.stddev_samp("w"), F.lit(0.0)), 1).alias("stddev_words"), F.coalesce(F.max("w"), F.lit(0)).alias("max_words")]
    for name in ("short", "medium", "long"):
        own = F.count_if(bucket == name)
        aggs += [own.alias(f"n_{name}"), F.bround(F.coalesce(F.try_divide(own.cast("double"), n.cast("double")), F.lit(0.0)), 3).alias(f"share_{name}")]
    tried = rows.agg(F.count("*").alias("n_attempted"))
    return ok.agg(*aggs).crossJoin(percentiles(ok, "w", {"p10_words": 0.1, "p50_words": 0.5, "p90_words": 0.9})).crossJoin(tried)


def boilerplate(rows: DataFrame, host: str, key: str, text: str) -> DataFrame:
    """Share of a text's non-blank lines that some other text of its host holds too; 0 without lines."""
    lines = rows.select(host, key, F.explode(F.split(text, "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''")
    counted = lines.groupBy(host, "line", key).agg(F.count("*").alias("n"))
    # Lines that two texts of a host hold: first and last key differ, so counts are pre-aggregated.
    common = counted.groupBy(host, "line").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select(host, "line", F.lit(1).alias("common"))
    shares = counted.join(common, [host, "line"], "left").groupBy(host, key).agg(F.sum("n").alias("lines"), F.coalesce(F.sum(F.col("n") * F.col("common")), F.lit(0)).alias("shared"))
    ratio = F.coalesce(F.try_divide(F.col("shared").cast("double"), F.col("lines").cast("double")), F.lit(0.0))
    return rows.select(host, key).join(shares, [host, key], "left").select(host, key, F.bround(F.coalesce(ratio, F.lit(0.0)), 6).alias("boilerplate_ratio"))


def throughputs(runs: DataFrame) -> DataFrame:
    """Last value per model, kind and prompt size of the benchmark runs (column ``seq`` orders them)."""
    rows = runs.withColumn("kind", F.when(F.col("n_prompt") > 0, "prefill").when(F.col("n_gen") > 0, "decode")).where("kind IS NOT NULL")
    rows = rows.withColumn("size", F.when(F.col("kind") == "prefill", F.col("n_prompt")).otherwise(0))
    return rows.groupBy("model", "kind", "size").agg(F.max_by("avg_ts", "seq").alias("speed"))


def interpolated(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Speed at each wanted ``tokens`` of a model: linear between measured sizes, flat beyond the ends."""
    met = wanted.join(points, "model")
    below = F.max(F.when(F.col("size") <= F.col("tokens"), F.struct("size", "speed"))).alias("below")
    above = F.min(F.when(F.col("size") >= F.col("tokens"), F.struct("size", "speed"))).alias("above")
    both = met.groupBy(*wanted.columns).agg(below, above)
    weight = (F.col("tokens") - F.col("below.size")) / (F.col("above.size") - F.col("below.size"))
    speed = F.when(F.col("below").isNull(), F.col("above.speed")).when(F.col("above").isNull() | (F.col("below.size") == F.col("above.size")), F.col("below.speed")).otherwise(F.col("below.speed") + weight * (F.col("above.speed") - F.col("below.speed")))
    return both.select(*wanted.columns, speed.alias("speed"))


def cost_report(prefill: DataFrame, decode: DataFrame, buckets: DataFrame, articles: int, parallel: int, tokens_per_word: float = 1.3, prompt_tokens: int = 300) -> DataFrame:
    """Per model: blended seconds an article over the buckets' shares, and of all articles in waves.

    buckets: bucket, words, share, output_tokens. prefill: model, size, speed. decode: model, decode_speed.
    """
    tokens = (F.col("words") * tokens_per_word).cast("int") + prompt_tokens
    wanted = decode.crossJoin(F.broadcast(buckets)).withColumn("tokens", tokens)  # three buckets
    rows = interpolated(prefill, wanted)
    seconds = F.col("tokens") / F.col("speed") + F.col("output_tokens") / F.col("decode_speed")
    waves = -(-articles // parallel)
    return rows.groupBy("model").agg(F.sum(F.col("share") * seconds).alias("b")).select("model", F.bround("b", 6).alias("blended_seconds"), F.bround(F.col("b") * articles, 6).alias("serial_seconds"), F.bround(F.col("b") * waves, 6).alias("fanout_seconds"))
