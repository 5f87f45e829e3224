"""Sliding windows over a stream in which rows that come too late are kept and counted, not dropped.

The watermark of a batch is the latest time of all batches before it, less a delay. A row counts in
each of its windows that ends after the watermark; for the others, which are closed, it goes to the
table ``late``, once for each. So the counts of windows and the late rows together are the input, a
row as often as it has windows. Rows without a time or value's group are kept: no time means late,
with no window; a null group is a group.

A batch adds one row for each window and group that it touches, as a batch of a journal whose commit
carries the watermark; a batch that is run again after a failure counts once. The result is the sum over batches.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltline.sources.journal import Journal


def _bound(journal: Journal) -> datetime | None:
    marks = [c["watermark"] for c in journal.commits() if c.get("watermark")]
    return datetime.fromisoformat(max(marks)) if marks else None


def window_journal(stream: DataFrame, root: str, checkpoint: str, time: str, group: str, value: str, width: str, slide: str | None = None, delay: timedelta = timedelta(minutes=10)) -> StreamingQuery:
    """Runs what there is of the stream into the journal at ``root``: tables ``windows`` and ``late``."""

    def step(batch: DataFrame, number: int) -> None:
        journal, seen = Journal(batch.sparkSession, root), Observation()
        name = f"stream-{number:09d}"
        if journal.has(name):
            return
        bound = _bound(journal)
        rows = batch.select(F.col(time).cast("timestamp").alias("time"), F.col(group).alias("group"), F.col(value).cast("double").alias("value"))
        placed = rows.where("time IS NOT NULL").withColumn("w", F.window("time", width, slide) if slide else F.window("time", width))
        closed = F.col("w.end") <= F.lit(bound) if bound else F.lit(False)
        open_ = placed.where(~closed).groupBy(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "group").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        late = placed.where(closed).select("time", "group", "value", F.col("w.start").alias("start"), F.col("w.end").alias("end"))
        nowhere = rows.where("time IS NULL").select("time", "group", "value", F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"))
        watched = late.unionByName(nowhere)
        tops = rows.observe(seen, F.max("time").alias("top"), F.count("*").alias("rows"))

        def note() -> dict:
            tops.write.format("noop").mode("overwrite").save()
            got = seen.get
            marks = [m for m in (bound, got["top"].astimezone(UTC) - delay if got["top"] else None) if m]
            return {"rows": got["rows"], "watermark": max(marks).isoformat() if marks else None}

        journal.write(name, {"windows": open_, "late": watched}, note)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _kind(spark: SparkSession, root: str, group_type: str) -> tuple[DataFrame, DataFrame]:
    journal = Journal(spark, root)
    windows = journal.read("windows", f"start timestamp, end timestamp, group {group_type}, n long, total double")
    return windows, journal.read("late", f"time timestamp, group {group_type}, value double, start timestamp, end timestamp")


def windows_so_far(spark: SparkSession, root: str, group_type: str = "string") -> DataFrame:
    """start, end, group, n, total of every window, and whether it is closed: no later row can change it."""
    windows, _ = _kind(spark, root, group_type)
    bound = _bound(Journal(spark, root))
    closed = F.col("end") <= F.lit(bound) if bound else F.lit(False)
    return windows.groupBy("start", "end", "group").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("closed", closed)


def late_rows(spark: SparkSession, root: str, group_type: str = "string") -> DataFrame:
    """time, group and value of rows that came too late, with the window that each missed."""
    return _kind(spark, root, group_type)[1]
