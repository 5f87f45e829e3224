"""Shards that all have the mixture of the whole: proportional stratified interleaving.

Within each stratum (source) rows are put in a seeded random order and numbered k = 0, 1, ...; a
row's fractional rank is (2k + 1) / 2n in a stratum of n rows. All rows sorted by fractional rank
interleave the strata in proportion at every place, and equal cuts of that order give shards whose
sizes differ by one row at most (the law ``rows``), each with the mixture of the whole up to a row
or two a stratum; a shard's own order has the mixture as well. Equal texts are not kept together:
their group may be larger than a shard.

Only built-in expressions are used. No window and no group holds a stratum: rows are sorted by
ranges, numbered in their partitions, and a table of a row for each partition gives what lies
before it; so a stratum or a set of copies of any size lies in many tasks. The rows are written
once with a number each, which orders rows equal in all columns; such rows get places that only
differ among themselves, whatever the number.

The order is by the MD5 of ``seed:id``, then id, CRC-32 and size; a null id counts as an empty one. Null
texts have size ``overhead`` and the CRC-32 of nothing. A null stratum is one of its own. No rows give no shards,
fewer rows than shards leave some empty. Very long texts are only measured, whole.
Other columns are not looked at, but for those in ``carry``, which may have any names except the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltline.llm.common import saved, text_bytes

LAW = "rows"
BROADCAST_STRATA = 100_000


def _numbered(rows: DataFrame, order: list[Column | str], name: str, table: str) -> DataFrame:
    """The rows in ``order`` over all partitions, written, with their number from 0 as ``name``."""
    done = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), table)
    # monotonically_increasing_id has the partition above 33 bits for the row's number in it
    part = F.shiftright("place", 33).alias("part")
    counts = done.groupBy(part).agg(F.count("*").alias("n"))
    before = counts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # a row for each partition: as many as tasks, whatever the number of rows
    found = done.join(F.broadcast(before), part == F.col("of"))
    return found.withColumn(name, F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("place", "of", "before")


def interleaved_shards(docs: DataFrame, identity: str, text: str, stratum: str, shards: int = 40, seed: int = 7, overhead: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (null: that is the law ``key``'s) and ``carry``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    raw = text_bytes(text)
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(identity).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(identity).alias("id"), F.octet_length(raw).cast("long").alias("bytes"), F.crc32(raw).alias("crc"), F.col(stratum).cast("string").alias("stratum"), shuffled.alias("mixed"), *kept)
    rows = saved(rows.withColumn("nth", F.monotonically_increasing_id()), "shard-rows")

    ranked = _numbered(rows, ["stratum", "mixed", "id", "crc", "bytes", "nth"], "at", "by-stratum")
    strata = saved(ranked.groupBy(F.col("stratum").alias("of")).agg(F.count("*").alias("members"), F.min("at").alias("start")), "strata")
    if strata.count() <= BROADCAST_STRATA:  # more are joined by shuffle, where large strata are split
        strata = F.broadcast(strata)
    ranked = ranked.join(strata, F.col("stratum").eqNullSafe(F.col("of"))).drop("of")
    fraction = (2 * (F.col("at") - F.col("start")) + 1).cast("double") / (2 * F.col("members")).cast("double")
    ranked = ranked.withColumn("fraction", fraction).drop("at", "start", "members")

    total = rows.count()
    mixed = _numbered(ranked, ["fraction", "stratum", "mixed", "id", "crc", "bytes", "nth"], "at", "interleaved")
    shard = F.expr(f"at * {shards}L div {total}L") if total else F.lit(0).cast("long")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")  # the smallest number whose shard this is
    mixed = mixed.withColumn("shard", shard)
    return mixed.select(
        F.col("id").alias(identity), (F.col("bytes") + overhead).alias("size"), F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)),
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """A folder of Parquet files for each shard, its rows in the order of their slots."""
    order = ["shard", "slot"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("shard").parquet(path)
