"""Tables that grow by numbered batches, each of which counts once: a list of commits beside the data.

A batch is first written to a folder of its own, then a commit file with its name appears in one
step. Readers see committed batches only. A writer that dies before its commit leaves a folder that
nobody reads and that the next attempt replaces; a batch that comes again finds its commit and is left
out. Many small batches are put together by ``compact``: its commit names the batches it replaces.

Keyed tables are split by a prefix of the key's hash, so the look-up whether keys are known reads
only the parts of the table that the batch's keys can be in. There are 16 ** ``width`` parts at most.
"""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "siltline_part"


class Journal:
    """``root`` holds ``commits/<batch>.json`` and ``<table>/batch=<batch>`` for each table of a batch."""

    def __init__(self, spark: SparkSession, root: str, width: int = 1) -> None:
        self.spark, self.root, self.width = spark, root.rstrip("/"), width
        self.jvm = spark._jvm
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _commit_file(self, batch: str):
        return self._path(f"commits/{quote(batch, safe='')}.json")

    def has(self, batch: str) -> bool:
        return self.files.exists(self._commit_file(batch)) or any(batch in c.get("replaces", ()) for c in self.commits())

    def commits(self) -> list[dict]:
        """What every commit says, in the order they were made; replaced ones are left out."""
        folder = self._path("commits")
        if not self.files.exists(folder):
            return []
        found = []
        for status in self.files.listStatus(folder):
            if status.getPath().getName().endswith(".json"):
                stream = self.files.open(status.getPath())
                try:
                    text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                found.append(json.loads(text))
        gone = {b for c in found for b in c.get("replaces", ())}
        return sorted((c for c in found if c["batch"] not in gone), key=lambda c: (c["number"], c["batch"]))

    def _commit(self, batch: str, tables: list[str], note: dict) -> bool:
        """Puts the commit in place in one step; False if another writer was first."""
        number = max((c["number"] for c in self.commits()), default=-1) + 1
        text = json.dumps({"batch": batch, "number": number, "tables": sorted(tables)} | note, sort_keys=True)
        part = self._path(f"commits/.{quote(batch, safe='')}.{self.jvm.java.util.UUID.randomUUID()}")
        out = self.files.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.files.exists(self._commit_file(batch)) or not self.files.rename(part, self._commit_file(batch)):
            self.files.delete(part, False)
            return False
        return True

    def _folder(self, table: str, batch: str) -> str:
        return f"{self.root}/{table}/batch={quote(batch, safe='')}"

    def write(self, batch: str, tables: dict[str, DataFrame], note: dict | None = None, by: str | None = None) -> bool:
        """Writes a batch's tables and commits it; False, and nothing new to read, if it was there before.

        ``note``: more entries of the commit, or a function that gives them once the tables are written.
        """
        if self.has(batch):
            return False
        for name, rows in tables.items():
            writer = rows.write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(self._folder(name, batch))
        return self._commit(batch, list(tables), (note() if callable(note) else note) or {})

    def read(self, table: str, schema: str | T.StructType) -> DataFrame:
        """The rows of all committed batches; the schema of a keyed table may name its part as a column."""
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        folders = [self._folder(table, c["batch"]) for c in self.commits() if table in c["tables"]]
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.root}/{table}").parquet(*folders).select(*kind.names)

    def part(self, key: str):
        return F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, self.width)

    def append_new(self, batch: str, rows: DataFrame, key: str, order: str, table: str = "rows") -> bool:
        """Adds the first row (by ``order``, then by the other columns) of each key that no committed batch has. Rows without a key are left out."""
        if self.has(batch):
            return False
        others = [c for c in rows.columns if c not in (key, order)]
        first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *others)).alias("first"))
        fresh = first.select(key, "first.*").withColumn(PART, self.part(key))
        known = self.read(table, T.StructType([*[f for f in rows.schema if f.name == key], T.StructField(PART, T.StringType())]))
        parts = [r[0] for r in fresh.select(PART).distinct().collect()]  # 16 ** width at most
        fresh = fresh.join(known.where(F.col(PART).isin(parts)).select(key), key, "left_anti")
        return self.write(batch, {table: fresh.select(*rows.columns, PART).hint("rebalance", PART)}, by=PART)

    def compact(self, tables: dict[str, str | T.StructType], by: str | None = None) -> bool:
        """One batch instead of all that are committed; ``tables`` names all tables and their schemas.

        The new commit names the old batches, so that they are still known when they come again, and keeps
        the greatest of each other entry. Old folders go: no reader may be at work on them.
        """
        old = self.commits()
        if len(old) < 2:
            return False
        if unknown := {t for c in old for t in c["tables"]} - tables.keys():
            raise ValueError(f"schemas of all tables are needed: {sorted(unknown)}")
        note = {k: max(c[k] for c in old if c.get(k) is not None) for k in {k for c in old for k in c if c[k] is not None} - {"batch", "number", "tables", "replaces"}}
        note["replaces"] = sorted({b for c in old for b in (c["batch"], *c.get("replaces", ()))})
        rows = {name: self.read(name, kind) for name, kind in tables.items()}
        done = self.write(f"compact-{old[-1]['number']}", {n: r.repartition(by) if by else r for n, r in rows.items()}, note, by)
        if done:
            for c in old:
                self.files.delete(self._commit_file(c["batch"]), False)
                for table in c["tables"]:
                    self.files.delete(self._path(f"{table}/batch={quote(c['batch'], safe='')}"), True)
        return done
