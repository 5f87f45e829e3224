"""Stored documents of several versions read as one table; what cannot be read is set aside with its reason.

A kind of document has a chain of versions, oldest first: each its schema, and how it becomes the next
one. A text is read with the schema of the version that it names (the newest, if it names none), and
goes up the chain to the newest. Every text gives one row: a document, or a reason and the text itself.
All of it is built-in expressions over one scan, and ``split`` writes both sides in one pass.

Reasons, the first that holds: no text; no JSON; no JSON object; unknown version; unknown keys; missing
keys (absent or null where the schema says NOT NULL); values of another type.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.sources.shared import shared_folder


@dataclass(frozen=True)
class Version:
    """``upgrade`` takes a struct of this version and gives one of the next; the newest version has none."""

    name: str
    ddl: str
    upgrade: Callable[[Column], Column] | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


class Chain:
    def __init__(self, *versions: Version) -> None:
        names = [v.name for v in versions]
        if not names or names != sorted(set(names)):
            raise ValueError("versions must be distinct and oldest first")
        if any((v.upgrade is None) != (v is versions[-1]) for v in versions):
            raise ValueError("every version but the newest needs an upgrade")
        self.versions = versions

    @property
    def newest(self) -> Version:
        return self.versions[-1]


def one_version(name: str, ddl: str) -> Chain:
    return Chain(Version(name, ddl))


def _loose(schema: T.StructType) -> T.StructType:
    """The schema with every top field nullable: what is missing is told by its name."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def _fault(text: Column, keys: Column, own: Column, version: Version) -> Column:
    names, schema = F.array(F.lit("version"), *[F.lit(f.name) for f in version.schema]), version.schema
    raw = {f.name: F.get_json_object(text, f"$['{f.name}']") for f in schema}
    listed = lambda found: F.array_join(F.array_sort(found), ", ")
    named = lambda cases: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cases])) if cases else F.array().cast("array<string>")
    unknown = F.array_except(keys, names)
    missing = named([(f.name, raw[f.name].isNull()) for f in schema if not f.nullable])
    wrong = named([(f.name, raw[f.name].isNotNull() & own[f.name].isNull()) for f in schema])
    return (
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown keys: "), listed(unknown))).when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), listed(missing)))
        .when(F.size(wrong) > 0, F.concat(F.lit("values of another type: "), listed(wrong)))
    )


def checked(rows: DataFrame, text: str, chain: Chain) -> DataFrame:
    """The rows with ``version``, ``document`` (a struct of the newest version; null if set aside) and ``reason``."""
    t = F.col(text)
    keys = F.json_object_keys(t)
    said = F.coalesce(F.get_json_object(t, "$.version"), F.lit(chain.newest.name))
    parsed = {v.name: F.from_json(t, _loose(v.schema)) for v in chain.versions}
    reason = F.when(t.isNull() | (F.trim(t) == ""), "no text").when(F.try_parse_json(t).isNull(), "no JSON").when(keys.isNull(), "no JSON object")
    reason = reason.when(~said.isin([v.name for v in chain.versions]), F.concat(F.lit("unknown version "), said))
    document, fault = F.lit(None), F.lit(None).cast("string")
    for i, v in enumerate(chain.versions):
        own = parsed[v.name]
        fault = F.when(said == v.name, _fault(t, keys, own, v)).otherwise(fault)
        for step in chain.versions[i:-1]:
            own = step.upgrade(own)
        kind = _loose(chain.newest.schema)
        document = F.when(said == v.name, own.cast(kind)).otherwise(document)
    told = rows.withColumns({"version": F.when(reason.isNull(), said), "reason": F.coalesce(reason, F.when(reason.isNull(), fault))})
    return told.withColumn("document", F.when(F.col("reason").isNull(), document))


def read_documents(spark: SparkSession, path: str, chain: Chain) -> DataFrame:
    """file, version, document, reason and (of what is set aside) text: a row for each file, empty ones too."""
    found = spark.read.format("binaryFile").load(path)
    rows = found.select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    # Spark lists files of no bytes but does not scan them
    plain = lambda c: F.regexp_replace(F.url_decode(c), "^([A-Za-z0-9]+):/+", "$1:/")
    listed = spark.createDataFrame([(x,) for x in found.inputFiles()], "file string").select(plain("file").alias("file"))
    empty = listed.join(found.select(F.regexp_replace("path", "^([A-Za-z0-9]+):/+", "$1:/").alias("file")), "file", "left_anti")
    rows = rows.unionByName(empty.withColumn("text", F.lit("")))
    done = checked(rows, "text", chain)
    return done.select("file", "version", "document", "reason", F.when(F.col("reason").isNotNull(), F.col("text")).alias("text"))


def split(rows: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of checked rows, both written in one pass below ``folder``."""
    spark = rows.sparkSession
    path = folder or shared_folder(spark, "checked")
    rows.withColumn("aside", F.col("reason").isNotNull()).write.partitionBy("aside").parquet(path)
    both = spark.read.schema(T.StructType([*rows.schema, T.StructField("aside", T.BooleanType())])).parquet(path)
    aside = both.where("aside").drop("aside", "document")
    return both.where("NOT aside").select(*[c for c in rows.columns if c not in ("document", "reason")], "document.*"), aside
