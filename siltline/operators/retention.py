"""Sizes of published files, and which visuals are old enough to go. Deleting is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.config import Retention

#: Endings of visuals.
VISUAL_SUFFIXES = ("avif", "jpeg", "jpg", "png", "svg", "webp")


def files(spark: SparkSession, root: str) -> DataFrame:
    """path and length of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def cutoff(today: Column, months: int) -> Column:
    """Months count 30 days; null if retention is off."""
    return F.lit(None).cast("date") if months < 0 else F.date_sub(today, months * 30)


def date_of(path: Column) -> Column:
    """The date of a relative path YYYY/MM/DD/..., or null."""
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", *(F.regexp_extract(path, r"^(\d{4})/(\d{1,2})/(\d{1,2})/", i) for i in (1, 2, 3))), F.lit("yyyy-M-d")))


def site_size(rows: DataFrame, config: Retention = Retention()) -> DataFrame:
    mb = F.coalesce(F.sum("length"), F.lit(0)) / 1_000_000
    return rows.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"), (mb > config.budget_mb).alias("over_budget"), F.bround(config.cap_mb - mb, 3).alias("headroom_mb"))


def candidates(rows: DataFrame, today: Column, months: int) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return rows.where(suffix.isin(*VISUAL_SUFFIXES) & (date_of(F.col("path")) < cutoff(today, months)))


def prune_report(rows: DataFrame, today: Column, months: int, dry_run: bool, fuse: int) -> DataFrame:
    """One row: considered, deleted, dry_run, fuse_tripped. Nothing is considered while retention is off."""
    n = F.count("*")
    deleted = F.lit(0).cast("long") if dry_run else F.least(n, F.lit(fuse))
    return candidates(rows, today, months).agg(n.alias("considered"), deleted.alias("deleted")).select("considered", "deleted", F.lit(dry_run).alias("dry_run"), (F.col("considered") > fuse).alias("fuse_tripped"))


def allowed(rows: DataFrame, today: Column, months: int, fuse: int) -> DataFrame:
    """The first paths in order that one run may delete."""
    return candidates(rows, today, months).orderBy("path").limit(fuse)
