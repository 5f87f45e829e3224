"""Schemas of the stored tables, and readers and writers that hold to them."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.functions import canonical
from siltline.sources import versions

_PLANNED = "item_id string, url_key string, source_url string, canonical_url string, source_id string, tier int, vertical string, title string, published_at string, carried_by int, watchlist_hit boolean, on_front_page boolean, rank_score double"
_DIGEST_ITEM = "item_id string, vertical string, title string, summary string, key_points array<string>, source_url string, source_id string, source_name string, source_kind string, tier int, published_at string, introduced_by_run int, band string, lenses array<string>, events array<string>, entities array<string>, rank_score double, visual struct<kind: string, path: string, alt_text: string, state: string>"
#: What a pipeline fingerprint digests: everything that can move an output.
INPUTS = {
    "model_sha256": "string", "quantisation": "string", "runtime_build": "string", "chat_template_sha256": "string", "prompt_sha256": "string", "output_schema_sha256": "string", "truncation_cap_tokens": "int", "sampling": "string",
    "n_ctx": "int", "n_batch": "int", "n_ubatch": "int", "n_threads": "int", "runner_class": "string", "extractor_version": "string", "sanitizer_version": "string",
}
DDL = {
    "feed": "id string, vertical string, title string, url string, tier int, kind string, weight double, status string, retired_on string",
    "vertical": "id string, display_name string, daily_cap int, min_feeds int, status string, retired_on string",
    "entity": "id string, display_name string, aliases array<string>, cik string, feeds array<string>, status string, retired_on string",
    "run_plan": f"version string, date string, stale boolean, items array<struct<{_PLANNED.replace(' ', ': ').replace(',:', ',')}>>, verticals array<struct<id: string, considered: int, planned: int, live_feeds: int, below_feed_floor: boolean>>",
    "planned_item": _PLANNED,
    "article": "version string, item_id string, url_key string, source_url string, canonical_url string, source_id string, tier int, vertical string, lenses array<string>, events array<string>, entities array<string>, carried_by int, rank_score double, title string, text string, word_count int, token_count int, truncated boolean, truncated_at_tokens int, published_at string, fetched_at string, status string, failure_detail string, extractor_version string, sanitizer_version string",
    "summary": "version string, item_id string, url_key string, summary string, key_points array<string>, pipeline_fingerprint string, output_digest string, model_id string, attempt int, source_truncated boolean, input_tokens int, output_tokens int, duration_ms int, fetch_ms int, extract_ms int, summarize_ms int, generated_at string, status string, failure_detail string",
    "route": "version string, item_id string, url_key string, kind string, rationale string, spec string, spec_format string, asset_path string, alt_text string, visual_state string, model_id string, routed_at string",
    "eval_row": "version string, date string, run_id string, item_id string, url_key string, source_url string, title string, vertical string, model_id string, attempt int, hhem double, hhem_full double, hhem_delta double, truncation_flagged boolean, coverage double, compression double, extractiveness double, verbatim_run double, unsupported_numbers int, hedge_dropped boolean, extraction_suspect boolean, band string, source_word_count int, source_seen_word_count int, summary_word_count int, pipeline_fingerprint string, output_digest string, determinism_violation boolean, scorer_version string, scored_at string, score_ms int",
    "fingerprint": f"version string, pipeline_fingerprint string, first_seen_run string, first_seen_at string, inputs struct<{', '.join(f'{n}: {t}' for n, t in INPUTS.items())}>, host_cpu string",
    "run_manifest": "version string, date string, runs array<struct<run_id: string, n: int, started_at: string, completed_at: string, status: string, commit_sha: string, runner: string, source_list_stale: boolean, items_planned: int, items_succeeded: int, items_failed: int, items_skipped: int, pipeline_fingerprints: array<string>, determinism_violations: int, site_bytes: bigint, site_files: int, note: string>>",
    "digest_day": f"version string, date string, generated_at string, partial boolean, items_planned int, items_failed int, retention_window_months int, runs array<struct<n: int, at: string, items_added: int>>, verticals array<struct<id: string, display_name: string, count: int>>, items array<struct<{', '.join(f'{n}: {t}' for n, _, t in (x.partition(' ') for x in _DIGEST_ITEM.split(', ', 17)))}>>, embeddings struct<model_id: string, dimensions: int, dtype: string, vectors: map<string, string>>",
    "validation": "version string, model_id string, is_incumbent boolean, selected boolean, leaderboard_hhem double, measured_hhem double, articles int, measured_on string, commit_sha string, runner string, verdict string, detail string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def exported() -> dict[str, str]:
    """Every schema as JSON, by name."""
    return {name: schema(name).json() for name in DDL}


def read_json(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Documents of one schema, one JSON value per file; a bad file stops the read (``read_checked`` sets it aside)."""
    return spark.read.schema(schema(name)).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_checked(spark: SparkSession, name: str, path: str, version: str = "1") -> DataFrame:
    """file, version, document, reason and text of every file: bad ones have a reason and their text, and no document."""
    return versions.read_documents(spark, path, versions.one_version(version, DDL[name]))


def documents(rows: DataFrame, name: str) -> DataFrame:
    """The canonical JSON text of each row of a schema, in ``document``; columns of no schema are kept beside it."""
    own = schema(name)
    more = [c for c in rows.columns if c not in own.names]
    return rows.select(*more, canonical.document(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in own]), own).alias("document"))


def write_documents(texts: DataFrame, path: str, text: str) -> DataFrame:
    """Writes each text to its own file: a temporary name first, then moved in place, so no reader sees half a file.

    Returns path, bytes and sha256 of each file; the files are written when the result is used.
    """

    def write(batches):
        for batch in batches:
            made = []
            for uri, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, own = pyarrow.fs.FileSystem.from_uri(uri)
                fs.create_dir(own.rpartition("/")[0], recursive=True)
                part = f"{own}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as out:
                    out.write(raw)
                fs.move(part, own)
                made.append((uri, len(raw), hashlib.sha256(raw).hexdigest()))
            yield pa.RecordBatch.from_pydict({"path": [m[0] for m in made], "bytes": [m[1] for m in made], "sha256": [m[2] for m in made]})

    return texts.select(path, F.col(text).cast("binary")).mapInArrow(write, "path string, bytes long, sha256 string")


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The names in a ledger's first line."""
    return spark.read.option("header", True).csv(path).columns


def read_ledger(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A CSV ledger by its columns' names; columns it lacks are null, a missing ledger is empty."""
    wanted = schema(name)
    try:
        rows = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], wanted)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def flattened(rows: DataFrame, column: str) -> DataFrame:
    """One level of a struct as columns of its own."""
    return rows.select(*[c for c in rows.columns if c != column], f"{column}.*")


def nested(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c not in names], F.struct(*names).alias(column))


def append_csv(rows: DataFrame, name: str, path: str) -> None:
    """Appends in the schema's order with a header; nothing is written for no rows."""
    if not rows.isEmpty():
        rows.select(*schema(name).names).write.mode("append").option("header", True).csv(path)


def append_by_date(rows: DataFrame, path: str, date: str) -> None:
    if not rows.isEmpty():
        rows.write.mode("append").partitionBy(date).parquet(path)


def overwrite_days(rows: DataFrame, path: str, date: str) -> None:
    """Replaces the days that ``rows`` holds, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def published_dates(days: DataFrame, date: str = "date") -> DataFrame:
    return days.select(date).distinct().orderBy(F.desc(date))


def manifest_runs(manifests: DataFrame) -> DataFrame:
    """One row per run of each manifest."""
    return manifests.select("date", F.explode("runs").alias("run")).select("date", "run.*")


def days_below(spark: SparkSession, root: str, file: str = "digest.json") -> DataFrame:
    """Dates of folders year/month/day below ``root`` that hold the file, newest first; other folders are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", file).load(root).select("path")
    parts = [F.regexp_extract("path", rf"/(\d{{4}})/(\d{{2}})/(\d{{2}})/{file}$", i) for i in (1, 2, 3)]
    return found.select(F.concat_ws("-", *parts).alias("date")).where("date <> '--'").distinct().orderBy(F.desc("date"))


def digests(spark: SparkSession, paths: str, piece: int = 1 << 20) -> DataFrame:
    """sha256 of each file below ``paths``, by path; files are read in pieces, so none is held whole."""

    def digest(batches):
        for batch in batches:
            made = []
            for uri in batch.column(0).to_pylist():
                fs, own = pyarrow.fs.FileSystem.from_uri(uri)
                total = hashlib.sha256()
                with fs.open_input_stream(own) as file:
                    while part := file.read(piece):
                        total.update(part)
                made.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["path", "sha256"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path")
    return listed.mapInArrow(digest, "path string, sha256 string")


def day_path(date: Column, root: str = "digest") -> Column:
    """The folder of a day, year/month/day."""
    return F.concat(F.lit(f"{root}/"), F.replace(date, F.lit("-"), F.lit("/")))


def asset_path(date: Column, item_id: Column, ordinal: Column, suffix: str = "svg") -> Column:
    return F.concat(day_path(date), F.lit("/"), item_id, F.lit("-"), F.lpad(ordinal.cast("string"), 2, "0"), F.lit(f".{suffix}"))


def results_in(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """JSON results of a folder with the file each came from, in name order."""
    return spark.read.schema(ddl).option("multiLine", True).json(folder).select(F.input_file_name().alias("file"), "*").orderBy("file")
