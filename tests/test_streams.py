"""Journals, late rows and states of streams: restarts, repeats and killed writers."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltline.operators import ledger
from siltline.sources.journal import PART, Journal
from siltline.streaming import late, observe
from siltline.streaming.append import append_stream

ROWS = "key string, n int, what string"


def of(journal):
    return sorted((r.key, r.n, r.what) for r in journal.read("rows", ROWS).collect())


def test_batches_count_once(spark, tmp_path):
    journal = Journal(spark, f"file://{tmp_path}/j")
    df = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    assert journal.read("rows", ROWS).collect() == [] and not journal.has("a")
    assert journal.append_new("a/1", df(("x", 2, "second"), ("x", 1, "first"), ("y", 1, "y"), (None, 1, "no key")), "key", "n")
    assert not journal.append_new("a/1", df(("z", 1, "never")), "key", "n")
    # a writer that was killed: data without a commit
    df(("w", 1, "lost")).withColumn(PART, journal.part("key")).write.partitionBy(PART).parquet(journal._folder("rows", "b"))
    assert of(journal) == [("x", 1, "first"), ("y", 1, "y")]
    assert journal.append_new("b", df(("y", 0, "late"), ("z", 1, "z"), ("z", 1, "z")), "key", "n")
    want = [("x", 1, "first"), ("y", 1, "y"), ("z", 1, "z")]
    assert of(journal) == want and [c["batch"] for c in journal.commits()] == ["a/1", "b"]
    kind = f"{ROWS}, {PART} string"
    assert journal.compact({"rows": kind}, PART) and of(journal) == want
    assert not journal.append_new("b", df(("q", 1, "again")), "key", "n") and journal.has("a/1") and len(journal.commits()) == 1
    assert journal.append_new("c", df(("x", 9, "known"), ("v", 1, "v")), "key", "n") and of(journal) == [("v", 1, "v"), *want]
    assert not journal.append_new("c", df(), "key", "n") and journal.append_new("d", df(), "key", "n") and journal.compact({"rows": kind}, PART)
    assert of(journal) == [("v", 1, "v"), *want] and {"a/1", "b", "c", "d"} <= set(journal.commits()[0]["replaces"])
    with pytest.raises(ValueError, match="schemas"):
        journal.append_new("e", df(("u", 1, "u")), "key", "n")
        journal.compact({}, PART)


def test_lookups_read_the_parts_of_the_batch_only(spark, tmp_path):
    journal = Journal(spark, f"file://{tmp_path}/j", width=2)
    keys = spark.range(2000).selectExpr("cast(id as string) AS key", "cast(id as int) AS n", "'a' AS what")
    journal.append_new("a", keys, "key", "n")
    parts = {r[0] for r in journal.read("rows", f"{ROWS}, {PART} string").select(PART).distinct().collect()}
    assert 250 < len(parts) <= 256
    one = spark.createDataFrame([("5", 1, "b")], ROWS)
    part = one.select(journal.part("key")).first()[0]
    known = journal.read("rows", f"key string, {PART} string").where(f"{PART} IN ('{part}')")
    assert f"{PART}#" in (plan := known._jdf.queryExecution().executedPlan().toString()).split("PartitionFilters")[1][:200] and known.count() < 40, plan


def test_a_stream_into_a_ledger_with_a_killed_writer(spark, tmp_path):
    source, root, state = (f"file://{tmp_path}/{x}" for x in ("in", "ledger", "state"))

    def run():
        append_stream(spark.readStream.schema(ROWS).parquet(source), root, state, "key", "n").awaitTermination()
        return of(Journal(spark, root))

    spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], ROWS).coalesce(1).write.parquet(source)
    assert run() == [("a", 1, "y"), ("b", 1, "z")] == run()
    # the batch was written and committed, but the stream's own commit was lost: it runs again
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))
    for file in [commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")]:
        file.unlink(missing_ok=True)
    assert run() == [("a", 1, "y"), ("b", 1, "z")]
    spark.createDataFrame([("a", 0, "known"), ("c", 1, "c")], ROWS).coalesce(1).write.mode("append").parquet(source)
    assert run() == [("a", 1, "y"), ("b", 1, "z"), ("c", 1, "c")]


def at(minute: int) -> datetime:
    return datetime(2026, 8, 1) + timedelta(minutes=minute)


def test_windows_and_late_rows_add_up(spark, tmp_path):
    source, root, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "t timestamp, g string, v double"

    def run(*rows):
        if rows:
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        late.window_journal(stream, root, state, "t", "g", "v", "10 minutes", "5 minutes", timedelta(minutes=10)).awaitTermination()
        windows = {(r.start, r.group): (r.n, r.total, r.closed) for r in late.windows_so_far(spark, root).collect()}
        return windows, sorted((r.time is not None, str(r.time), r.group, str(r.start)) for r in late.late_rows(spark, root).collect())

    windows, missed = run((at(1), "a", 1.0), (at(31), "a", 2.0), (at(31), None, 4.0))
    assert windows[at(0), "a"] == (1, 1.0, True) and windows[at(30), None] == (1, 4.0, False) and len(windows) == 6 and missed == []
    # the watermark is 00:21: of a row at 00:14 the window from 00:05 is closed, that from 00:10 too; of 00:16 only the first
    windows, missed = run((at(14), "a", 8.0), (at(16), "a", 16.0), (None, "b", 1.0))
    assert windows[at(15), "a"] == (1, 16.0, False) and (at(10), "a") not in windows
    assert missed == [(False, "None", "b", "None"), (True, str(at(14)), "a", str(at(5))), (True, str(at(14)), "a", str(at(10))), (True, str(at(16)), "a", str(at(10)))]
    assert sum(n for n, _, _ in windows.values()) + len(missed) - 1 == 2 * 5
    assert run() == (windows, missed)
    journal = Journal(spark, root)
    assert journal.compact({"windows": "start timestamp, end timestamp, group string, n long, total double", "late": "time timestamp, group string, value double, start timestamp, end timestamp"})
    assert run() == (windows, missed) and late._bound(Journal(spark, root)) is not None
    windows, missed = run((at(2), "c", 1.0))
    assert len(missed) == 6 and (at(0), "c") not in windows


def test_observations_of_a_stream_equal_the_batch_and_states_expire(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "k long, fingerprint string, output_digest string, t timestamp"
    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        seen = observe.observed(stream, "k", "fingerprint", "output_digest", "t", timedelta(minutes=60))
        seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.item, r.at, r.observation) for r in spark.read.schema("item string, at timestamp, observation string").parquet(out).collect())

    with observe.rocksdb(spark):
        first = [(1, "f", "o", at(0)), (2, "f", "o", at(0)), (3, "f", "o", at(0)), (4, "f", None, at(0)), (5, None, "o", at(0))]
        second = [(1, "f", "o", at(10)), (2, "g", "o", at(10)), (3, "f", "p", at(10)), (4, "f", "o", at(10)), (5, "f", "o", at(10)), (6, "f", "o", at(10)), (None, "f", "o", at(10))]
        assert {o for _, _, o in run(*first)} == {"first_run"}
        got = {i: o for i, t, o in run(*second) if t == at(10)}
        frame = lambda rows: spark.createDataFrame(rows, schema).where("k IS NOT NULL")
        want = {str(r.k): r.observation for r in ledger.classify(frame(second), frame(first), "k").collect()}
        assert got == want and set(want.values()) == {"first_run", "inputs_changed", "unchanged", "determinism_violation"}
        run((7, "f", "o", at(200)))  # moves the watermark, and the states of 1 to 6 go
        late_again = {i: o for i, t, o in run((1, "f", "o", at(201)), (7, "f", "o", at(201))) if t == at(201)}
        assert late_again == {"1": "first_run", "7": "unchanged"}


def test_items_of_one_drawer_keep_their_own_states_and_times(spark, tmp_path):
    """One drawer for all: some items expire, others stay, and an item that came again later stays too."""
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "k long, fingerprint string, output_digest string, t timestamp"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        seen = observe.observed(spark.readStream.schema(schema).parquet(source), "k", "fingerprint", "output_digest", "t", timedelta(minutes=60), drawers=1)
        seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        last = max(r[3] for r in rows)
        return {i.item: i.observation for i in spark.read.schema("item string, at timestamp, observation string").parquet(out).where(F.col("at") == F.lit(last)).collect()}

    with observe.rocksdb(spark):
        run(*((k, "f", None if k == 3 else "o", at(0)) for k in range(1, 6)))
        assert run((2, "f", "o", at(50)), (4, "g", "o", at(50))) == {"2": "unchanged", "4": "inputs_changed"}
        run((9, "f", "o", at(70)))  # the states of 1, 3 and 5 go, those of 2 and 4 stay until 110
        assert run(*((k, "g", "o", at(71)) for k in range(1, 6))) == {"1": "first_run", "2": "inputs_changed", "3": "first_run", "4": "unchanged", "5": "first_run"}
