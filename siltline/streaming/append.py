"""Streams: incremental append without repeats, counts over event-time windows, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltline.sources.journal import Journal


def append_stream(stream: DataFrame, ledger_path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Adds rows of keys that the ledger lacks, batch by batch, and ends when the input does.

    The ledger is a journal: a batch that is run again, also after its writer was killed, counts once,
    and a batch reads only the parts of the ledger that its keys can be in.
    """

    def write(batch: DataFrame, number: int) -> None:
        Journal(batch.sparkSession, ledger_path).append_new(f"stream-{number:09d}", batch, key, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark; state older than it is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, time: str, group: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows and sums of ``value`` per window and group; rows later than the watermark are dropped (``late.window_journal`` keeps them)."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), group).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", group, "n", "total")


def sessions(rows: DataFrame, time: str, group: str, gap: str) -> DataFrame:
    return rows.groupBy(F.session_window(time, gap).alias("w"), group).agg(F.count("*").alias("n")).select("w.start", "w.end", group, "n")
