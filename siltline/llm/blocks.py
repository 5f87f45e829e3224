"""Groups of any size in bounded blocks: every two members of a group meet in some task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltline.llm.common import saved


def block_pairs(rows: DataFrame, key: str, identity: str, size: int = 256) -> DataFrame:
    """Deals the members of each key's group into blocks of about ``size`` and each block to all others.

    Adds ``left_block``, ``right_block`` and ``block``; the rows of one (key, left_block,
    right_block) are adjacent in one partition. Keys with one member are left out.
    """
    sizes = saved(rows.groupBy(key).agg(F.count("*").alias("members")).where("members > 1"), "group-sizes")
    n = F.ceil(F.col("members") / size).cast("int")
    dealt = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64(identity, key), n).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.withColumns({"left_block": F.least("block", "other"), "right_block": F.greatest("block", "other")}).drop("other", "members")
    cell = [key, "left_block", "right_block"]
    return dealt.repartition(*cell).sortWithinPartitions(*cell)


def strangers(rows: DataFrame, key: str, identity: str, kind: str, size: int = 256) -> DataFrame:
    """``block_pairs`` for members of several kinds, of which two of one kind need not meet.

    Kinds of ``size`` members and more in a group have blocks of their own, the others share blocks.
    Blocks of one and the same kind are not dealt to each other: so where all but a few members are of
    one kind, its members are dealt once for each block of others, and the few to all blocks.
    """
    kinds = rows.groupBy(key, kind).agg(F.count("*").alias("members"))
    of = kinds.select(key, F.col(kind).alias("of_kind"), F.when(F.col("members") >= size, F.ceil(F.col("members") / size)).otherwise(0).cast("int").alias("own"), "members")
    before = Window.partitionBy(key).orderBy("of_kind").rowsBetween(Window.unboundedPreceding, -1)  # kinds of a group that have blocks of their own
    large = of.where("own > 0").withColumn("offset", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int"))
    groups = of.groupBy(F.col(key).alias("of_key")).agg(F.ceil(F.sum(F.when(F.col("own") == 0, F.col("members")).otherwise(0)) / size).cast("int").alias("shared"), F.sum("own").cast("int").alias("pure"), F.sum("members").alias("all"), F.count("*").alias("kinds"))
    groups = saved(groups.where("all > 1 AND kinds > 1"), "group-sizes")
    placed = rows.join(groups, rows[key] == groups["of_key"]).drop("of_key")
    large = saved(large.select(F.col(key).alias("of_key"), "of_kind", "own", "offset"), "large-kinds")
    placed = placed.join(large, (placed[key] == large["of_key"]) & (placed[kind] == large["of_kind"]), "left").drop("of_key", "of_kind")
    hashed, first = F.xxhash64(identity, key), F.col("shared") + F.col("offset")
    last = F.col("shared") + F.col("pure") - 1
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    others = F.when(F.col("own").isNull(), upto(F.lit(0), last)).otherwise(F.concat(upto(F.lit(0), first - 1), upto(first + F.col("own"), last)))
    block = F.when(F.col("own").isNull(), F.pmod(hashed, F.greatest("shared", F.lit(1)))).otherwise(first + F.pmod(hashed, "own")).cast("int")
    dealt = placed.withColumn("block", block).withColumn("other", F.explode(others))
    dealt = dealt.withColumns({"left_block": F.least("block", "other"), "right_block": F.greatest("block", "other")}).drop("other", "shared", "pure", "all", "kinds", "own", "offset")
    cell = [key, "left_block", "right_block"]
    return dealt.repartition(*cell).sortWithinPartitions(*cell)


def cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The runs of equal values of ``names`` in a partition sorted by them, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        marks = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], 1)
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if held and not np.array_equal(marks[a], last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = marks[a]
    if held:
        yield pa.Table.from_batches(held)
