from __future__ import annotations

import pytest

from siltline.llm import common


def test_tables_are_removed(spark):
    one, two = (common.saved(spark.range(3), name) for name in ("one", "two"))
    common.discard(one)
    assert two.count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(one.siltline_path).count()
    folder = common.shared_folder(spark, "x").rpartition("/")[0]
    keep = folder + "-other"
    two.write.parquet(keep)
    assert folder.endswith(spark.sparkContext.applicationId) and spark.read.parquet(keep).count() == 3


def test_tables_of_a_machine_are_for_local_runs_only(spark):
    class Context:
        master, applicationId = "spark://x:7077", "a"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: None)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session(), "x")
