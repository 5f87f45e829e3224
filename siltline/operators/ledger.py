"""Append-only ledgers: stamps of inputs, what changed, what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.functions import canonical


def fingerprint(inputs: dict[str, tuple[Column, str]]) -> Column:
    """sha256 of the inputs, each a column and its type, as canonical JSON. A null stays null in the text."""
    kind = T.StructType([T.StructField(k, T.StructType.fromDDL(f"x {t}")["x"].dataType) for k, (_, t) in inputs.items()])
    return canonical.digest(F.struct(*[c.cast(t).alias(k) for k, (c, t) in inputs.items()]), kind)


def read_ledger(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row written for each key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("nth", last).where("nth = 1").drop("nth")


def classify(current: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """current and prior have ``key``, fingerprint and output_digest (null before the work is done)."""
    was = prior.select(key, F.col("fingerprint").alias("was"), F.col("output_digest").alias("was_output"))
    rows = current.join(was, key, "left")
    seen = (
        F.when(F.col("was").isNull(), "first_run")
        .when(F.col("was") != F.col("fingerprint"), "inputs_changed")
        .when(F.col("output_digest").isNull() | F.col("was_output").isNull(), "unchanged")
        .when(F.col("output_digest") != F.col("was_output"), "determinism_violation")
        .otherwise("unchanged")
    )
    return rows.select(key, seen.alias("observation"), (seen == "unchanged").alias("skippable"))


def append_new(rows: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key that ``known`` does not hold."""
    fresh = rows.join(known.select(key), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return fresh.withColumn("nth", first).where("nth = 1").drop("nth")
