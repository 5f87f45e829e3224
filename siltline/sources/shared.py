"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; one of this machine only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siltline-")
        spark.conf.set("spark.checkpoint.dir", root)
    root = "file://" + root if root.startswith("/") else root
    return f"{root.rstrip('/')}/siltline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a shared folder and read again: what comes after does not depend on lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Removes what ``saved`` and queries of this application wrote; results that are not yet used go with it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, "x").rpartition("/")[0])
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
