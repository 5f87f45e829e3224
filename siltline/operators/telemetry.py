"""A structured log of runs: one event, one flat row, written beside the tables and read as one.

Envelope: ts, src, v, run, name, level, ctx and data, the last two open maps of texts. Stages are
observed where they run: their counts come from the job that computes them, not from a second one. A
stage that fails leaves ``stage.failed``, and its run ends ``run.partial``. Streams are logged by a
listener, one event a batch. There is no sink but the table.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "ts timestamp, src string, v string, run string, name string, level string, ctx map<string,string>, data map<string,string>"
VERSION = "1"


class Log:
    """Events of one run; ``path`` is a folder of JSON lines that all runs add to."""

    def __init__(self, spark: SparkSession, path: str, run: str | None = None) -> None:
        self.spark, self.path, self.run = spark, path, run or uuid.uuid4().hex
        self.held: list[tuple] = []
        self.lock, self.failed = threading.Lock(), False

    def event(self, src: str, name: str, level: str = "info", ctx: dict | None = None, data: dict | None = None) -> None:
        texts = lambda x: {k: None if v is None else str(v) for k, v in (x or {}).items()}
        with self.lock:
            self.held.append((datetime.now(UTC), src, VERSION, self.run, name, level, texts(ctx), texts(data)))

    def flush(self) -> None:
        """Adds the events held to the table, in one file."""
        with self.lock:
            held, self.held = self.held, []
        if held:
            self.spark.createDataFrame(held, SCHEMA).coalesce(1).write.mode("append").json(self.path)

    @contextlib.contextmanager
    def running(self, src: str) -> Iterator[Log]:
        """A run from ``run.started`` to ``run.completed``, or ``run.partial`` if a stage or the run failed."""
        self.event(src, "run.started")
        try:
            yield self
        except BaseException as error:
            self.failed = True
            self.event(src, "run.partial", "error", data={"error": f"{type(error).__name__}: {error}"[:500]})
            raise
        else:
            self.event(src, "run.partial" if self.failed else "run.completed", "warning" if self.failed else "info")
        finally:
            self.flush()

    def stage(self, src: str, rows: DataFrame, write: Callable[[DataFrame], None], measures: dict[str, Column] | None = None, ctx: dict | None = None) -> bool:
        """Writes the rows of a stage and logs how many there were, with more measures over them; False if it failed."""
        self.event(src, "stage.started", ctx=ctx)
        seen = Observation(f"{src}-{uuid.uuid4().hex}")
        try:
            write(rows.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in (measures or {}).items()]))
        except Exception as error:
            self.failed = True
            self.event(src, "stage.failed", "error", ctx, {"error": f"{type(error).__name__}: {error}"[:500]})
            return False
        self.event(src, "stage.completed", ctx=ctx, data=seen.get)
        return True

    def listener(self, src: str) -> StreamingQueryListener:
        """For ``spark.streams.addListener``: progress and ends of streaming queries as events."""
        log = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                log.event(src, "stage.started", ctx={"query": event.id})

            def onQueryProgress(self, event) -> None:
                p = event.progress
                late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
                log.event(src, "stage.progress", ctx={"query": p.id, "batch": p.batchId}, data={"rows": p.numInputRows, "watermark": p.eventTime.get("watermark"), "late": late, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

            def onQueryIdle(self, event) -> None:
                pass

            def onQueryTerminated(self, event) -> None:
                log.failed |= event.exception is not None
                log.event(src, "stage.failed" if event.exception else "stage.completed", "error" if event.exception else "info", {"query": event.id}, {"error": event.exception[:500]} if event.exception else {})

        return Listener()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
