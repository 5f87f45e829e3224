"""Counts of the log are those of the tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltline.operators.telemetry import Log, read_log


def test_stages_failures_and_streams(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = Log(spark, path, "run-1")
    put = lambda name: lambda df: df.write.parquet(f"file://{tmp_path}/{name}")
    rows = spark.range(100).withColumn("x", F.col("id") % 7)
    with log.running("pipeline"):
        assert log.stage("all", rows, put("all"), {"last": F.max("id")}, {"source": "range"})
        assert log.stage("some", rows.where("x > 2"), put("some"), {"kinds": F.count_distinct("x")}) is False  # distinct counts cannot be observed
        assert log.stage("some", rows.where("x > 2"), put("some"), {"nulls": F.count_if(F.col("x").isNull())})
        assert log.stage("none", rows.where("x > 9"), put("none"), {"last": F.max("id")})
        assert not log.stage("bad", rows.withColumn("y", F.raise_error(F.lit("broken"))), put("bad"))
    listener = log.listener("stream")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long, x long").parquet(f"file://{tmp_path}/all")
        stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    log.flush()
    log.flush()
    events = read_log(spark, path).orderBy("ts").collect()
    done = {e.src: e.data for e in events if e.name == "stage.completed"}
    for name in ("all", "some", "none"):
        assert int(done[name]["rows"]) == spark.read.parquet(f"file://{tmp_path}/{name}").count()
    assert done["all"]["last"] == "99" and done["none"]["last"] is None and done["some"]["nulls"] == "0"
    assert [e.src for e in events if e.name == "stage.failed"] == ["some", "bad"] and [e.name for e in events if e.src == "pipeline"] == ["run.started", "run.partial"]
    assert {e.run for e in events} == {"run-1"} and {e.v for e in events} == {"1"} and next(e.ctx for e in events if e.src == "all") == {"source": "range"}
    assert sum(int(e.data["rows"]) for e in events if e.name == "stage.progress") == 100
    with pytest.raises(ValueError, match="x"), Log(spark, path, "run-2").running("other"):
        raise ValueError("x")
    assert [e.name for e in read_log(spark, path).where("run = 'run-2'").orderBy("ts").collect()] == ["run.started", "run.partial"]
