"""What changed since an item was last seen, on a stream: one state of two digests for each item, dropped in time.

The state is the last stamp of an item: the fingerprint of its inputs and the digest of its output.
Every row is compared with the item's row before it, in the order of event time. Items lie in drawers by
their hash; a drawer's state is read and written once a batch, since each call to it costs more than
many items. A timer drops an item's state ``keep`` after its last row has passed the watermark, so that state does not grow with all items ever seen; an item that comes back later is
a first run again. The state lives in RocksDB and its checkpoint, not in Python.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "item array<string>, fingerprint array<string>, output_digest array<string>, at array<long>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def observation(was: tuple | None, fingerprint: str | None, output: str | None) -> str:
    """The same cases as ``ledger.classify``, for one row and the state before it."""
    if was is None or was[0] is None:
        return "first_run"
    if fingerprint is not None and was[0] != fingerprint:
        return "inputs_changed"
    if output is None or was[1] is None:
        return "unchanged"
    return "unchanged" if was[1] == output else "determinism_violation"


class Observer(StatefulProcessor):
    """One call for a drawer of items: its state is four lists of the same length, an entry for each item that is kept."""

    def __init__(self, keep: timedelta) -> None:
        self.keep = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def _read(self) -> dict[str, tuple]:
        was = self.last.get()
        return {} if was is None else {i: (f, o, at) for i, f, o, at in zip(*was, strict=True)}

    def _write(self, kept: dict[str, tuple]) -> None:
        """Writes what is kept and sets the drawer's only timer to the first of its items that will go."""
        if not kept:
            self.last.clear()
            return
        self.last.update((list(kept), *map(list, zip(*kept.values(), strict=True))))
        self.handle.registerTimer(min(at for _, _, at in kept.values()) + self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["at", "fingerprint", "output_digest"], kind="stable")
        kept = self._read()
        if kept:  # its timer is known by its time, so none is listed
            self.handle.deleteTimer(min(at for _, _, at in kept.values()) + self.keep)
        seen = []
        for i, f, o, at in zip(own["item"], own["fingerprint"], own["output_digest"], own["at"], strict=True):
            f, o = None if pd.isna(f) else f, None if pd.isna(o) else o
            seen.append(observation(kept.get(i), f, o))
            kept[i] = (f, o, int(at.value // 1_000_000))
        self._write(kept)
        yield pd.DataFrame({"item": list(own["item"]), "at": list(own["at"]), "observation": seen})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        self._write({i: x for i, x in self._read().items() if x[2] + self.keep > fired and x[2] + self.keep >= mark})
        yield pd.DataFrame({"item": pd.Series([], dtype=object), "at": pd.Series([], dtype="datetime64[ns]"), "observation": pd.Series([], dtype=object)})

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which state with timers needs; others are left as they were."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def observed(stream: DataFrame, item: str, fingerprint: str, output: str, time: str, keep: timedelta, late: str = "0 seconds", drawers: int = 1 << 12) -> DataFrame:
    """item (text), at, observation and skippable of every row of the stream that has an item and a time.

    Start it inside ``with rocksdb(spark)``. ``drawers`` stays as it is for a checkpoint; a batch rewrites
    the drawers that its items lie in, so many items in small batches want more of them.
    """
    rows = stream.select(F.col(item).cast("string").alias("item"), F.col(fingerprint).alias("fingerprint"), F.col(output).alias("output_digest"), F.col(time).cast("timestamp").alias("at"))
    rows = rows.where("item IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    seen = rows.withColumn("drawer", F.pmod(F.xxhash64("item"), F.lit(drawers))).groupBy("drawer").transformWithStateInPandas(Observer(keep), "item string, at timestamp, observation string", "Append", "EventTime")
    return seen.withColumn("skippable", F.col("observation") == "unchanged")
