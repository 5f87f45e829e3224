"""Daily summaries give the alerts of the rows they came from."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from siltline.operators import drift


def test_spans_of_kept_days_equal_the_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"2026-08-{rng.randrange(1, 21):02d}", rng.choice(["a", "b", "c", None]), rng.choice([None, *range(100, 2000)]), rng.random(), rng.choice([0.0, 0.5, 1.0, None])) for _ in range(600)]
    rows = [(d, s, w // 3 if w and d > "2026-08-10" and s == "a" else w, x + 0.3 * (d > "2026-08-10" and s == "b"), h) for d, s, w, x, h in rows] + [("2026-08-15", "only now", 5, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "date string, domain string, words long, extractiveness double, hhem double")
    path = f"file://{tmp_path}/days"
    drift.keep_days(df.where("date < '2026-08-16'"), path)
    drift.keep_days(df.where("date >= '2026-08-16'"), path)
    drift.keep_days(df.where("date = '2026-08-16'"), path)  # again: no row counts twice
    for recent, baseline in ((("2026-08-11", "2026-08-20"), ("2026-08-01", "2026-08-10")), (("2026-08-16", "2026-08-16"), ("2026-08-01", "2026-08-15"))):
        want = drift.compare(df.where(F.col("date").between(*recent)), df.where(F.col("date").between(*baseline)))
        got = drift.compare_days(drift.kept_days(spark, path), recent, baseline)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and (got.count() > 1 or recent[0] == recent[1])
    one = drift.kept_days(spark, path).where("date = '2026-08-16'")
    assert "PartitionFilters: [isnotnull(date" in one._jdf.queryExecution().executedPlan().toString()
    assert {f.rpartition("date=")[2][:10] for f in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {"2026-08-16"}
