"""Registered queries of what comes in runs: streams, batches of a ledger, late rows, documents of several versions. Each has its SQL beside it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.functions import table_functions
from siltline.operators import drift, telemetry
from siltline.plans import oracles
from siltline.plans.queries import Query
from siltline.sources import tables as S
from siltline.sources import versions
from siltline.sources.journal import PART, Journal
from siltline.sources.shared import shared_folder
from siltline.sources.versions import Chain, Version
from siltline.streaming import late, observe

BASE = datetime(2026, 8, 1)
SECONDS = int((BASE - datetime(1970, 1, 1)).total_seconds())


def _fed(rows: DataFrame, number: str, batches: int, run) -> None:
    """Puts the rows of batch 0, 1, ... in a folder that a stream reads, and lets the stream run after each."""
    source = shared_folder(rows.sparkSession, "stream-input")
    for i in range(batches):
        rows.where(F.col(number) == i).drop(number).write.mode("append").parquet(source)
        run(rows.sparkSession.readStream.schema(rows.drop(number).schema).parquet(source))


def ledger_batches(spark, sf):
    """Documents in four batches; one comes twice, the writer of one is killed, and then all become one."""
    key = F.concat_ws("/", "source", F.col("n_chars") % 5000)
    rows = S.table(spark, sf, "documents").select(key.alias("key"), "doc_id", "lang")
    journal, kind = Journal(spark, shared_folder(spark, "journal")), f"key string, doc_id long, lang string, {PART} string"
    for i in (0, 1, 2, 1):
        journal.append_new(f"run-{i}", rows.where(F.col("doc_id") % 4 == i), "key", "doc_id")
    rows.where("doc_id % 4 = 3").withColumn(PART, journal.part("key")).write.partitionBy(PART).parquet(journal._folder("rows", "run-3"))
    journal.append_new("run-3", rows.where("doc_id % 4 = 3"), "key", "doc_id")
    journal.compact({"rows": kind}, PART)
    return journal.read("rows", kind).drop(PART)


def _turns(spark, sf):
    """Turns with a time, and the batch in which each arrives: every fifth comes one later than its conversation."""
    rows = S.table(spark, sf, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    last = rows.agg(F.max("conv_id")).first()[0] or 0
    number = F.least(F.lit(3), F.floor(F.col("conv_id") * 4 / (last + 1)) + F.when(F.col("turn") % 5 == 4, 1).otherwise(0))
    return rows.select("conv_id", "role", F.col("turn").cast("double").alias("value"), F.timestamp_seconds(F.lit(SECONDS) + F.col("conv_id") * 60 + F.col("turn") * 20).alias("t"), number.alias("number"))


def late_windows(spark, sf):
    """Turns in sliding windows of twenty minutes, streamed in four batches; what came too late is counted beside them."""
    root, state = shared_folder(spark, "windows"), shared_folder(spark, "stream-state")
    _fed(_turns(spark, sf), "number", 4, lambda s: late.window_journal(s, root, state, "t", "role", "value", "20 minutes", "10 minutes", timedelta(minutes=10)).awaitTermination())
    windows = late.windows_so_far(spark, root).select(F.when(F.col("closed"), "closed").otherwise("open").alias("kind"), "start", F.col("group").alias("role"), "n", "total")
    missed = late.late_rows(spark, root).groupBy("start", F.col("group").alias("role")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = windows.unionByName(missed.withColumn("kind", F.lit("late")))
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


LATE_WINDOWS_SQL = """
WITH top AS (SELECT max(conv_id) AS top FROM conversations WHERE turn IS NOT NULL),
turns AS (
  SELECT role, CAST(turn AS DOUBLE) AS value, conv_id * 60 + turn * 20 AS s, least(3, conv_id * 4 // (top + 1) + CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END) AS b
  FROM conversations, top WHERE conv_id IS NOT NULL AND turn IS NOT NULL
),
tops AS (SELECT b, max(s) AS s FROM turns GROUP BY b),
bounds AS (SELECT x.b, coalesce(max(tops.s), -1000000) - 600 AS bound FROM (SELECT unnest(range(5)) AS b) x LEFT JOIN tops ON tops.b < x.b GROUP BY x.b),
placed AS (SELECT role, value, t.b, s // 600 * 600 - 600 * i.i AS start, bound FROM turns t JOIN bounds USING (b), (SELECT unnest([0, 1]) AS i) i),
told AS (SELECT *, CASE WHEN start + 1200 <= bound THEN 'late' WHEN start + 1200 <= (SELECT bound FROM bounds WHERE b = 4) THEN 'closed' ELSE 'open' END AS kind FROM placed)
SELECT kind, strftime(TIMESTAMP '2026-08-01 00:00:00' + to_seconds(start), '%Y-%m-%d %H:%M:%S') AS start, role, count(*) AS n, sum(value) AS total FROM told GROUP BY ALL
"""


def _stamped(spark, sf):
    """Two runs over conversations as items, with changed inputs, outputs that differ, are missing, or come for the first time."""
    k = F.col("conv_id")
    items = S.table(spark, sf, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("role").alias("r"))
    one = F.concat(F.lit("f"), F.col("n") % 3)
    first = items.where(k % 13 != 0).select(k, F.sha2(one, 256).alias("fingerprint"), F.sha2("r", 256).alias("output_digest"), F.lit(0).alias("number"))
    output = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("r", 256))
    second = items.where(k % 17 != 0).select(k, F.sha2(F.when(k % 5 == 0, "g").otherwise(one), 256).alias("fingerprint"), output.alias("output_digest"), F.lit(1).alias("number"))
    return first.unionByName(second).withColumn("t", F.timestamp_seconds(F.lit(SECONDS) + F.col("number") * 86400))


def stream_observations(spark, sf):
    """What changed since an item was last seen, by a stream that is stopped and started between two runs."""
    out, state = shared_folder(spark, "observations"), shared_folder(spark, "stream-state")

    def run(stream: DataFrame) -> None:
        seen = observe.observed(stream, "conv_id", "fingerprint", "output_digest", "t", timedelta(days=30))
        seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    with observe.rocksdb(spark):
        _fed(_stamped(spark, sf), "number", 2, run)
    rows = spark.read.schema("item string, at timestamp, observation string, skippable boolean").parquet(out)
    return rows.select(F.col("item").cast("long").alias("conv_id"), F.date_format("at", "yyyy-MM-dd").alias("date"), "observation", "skippable")


STREAM_OBSERVATIONS_SQL = """
WITH items AS (SELECT conv_id, count(*) AS n, max(role) AS r FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
told AS (
  SELECT conv_id, '2026-08-01' AS date, 'first_run' AS observation FROM items WHERE conv_id % 13 <> 0 UNION ALL
  SELECT conv_id, '2026-08-02', CASE WHEN conv_id % 13 = 0 THEN 'first_run' WHEN conv_id % 5 = 0 THEN 'inputs_changed' WHEN conv_id % 7 = 0 OR r IS NULL THEN 'unchanged' WHEN conv_id % 11 = 0 THEN 'determinism_violation' ELSE 'unchanged' END
  FROM items WHERE conv_id % 17 <> 0
)
SELECT conv_id, date, observation, observation = 'unchanged' AS skippable FROM told
"""

#: Three versions of one kind of document: names changed, a text became a number, a field was added.
CHAIN = Chain(
    Version("2026-01-01", "id long NOT NULL, language string NOT NULL, chars string", lambda d: F.struct(d["id"].alias("doc_id"), d["language"].alias("lang"), d["chars"].try_cast("long").alias("n_chars"))),
    Version("2026-05-01", "doc_id long NOT NULL, lang string NOT NULL, n_chars long", lambda d: F.struct(d["doc_id"].alias("doc_id"), d["lang"].alias("lang"), d["n_chars"].alias("n_chars"), F.lit("unknown").alias("source"))),
    Version("2026-08-01", "doc_id long NOT NULL, lang string NOT NULL, n_chars long, source string NOT NULL"),
)


def versioned_documents(spark, sf):
    """Documents stored in three versions, some cut off, of an unknown version, or with keys too many, missing or of another type."""
    k, js = F.col("doc_id") % 12, lambda **c: F.to_json(F.struct(*[v.alias(n) for n, v in c.items()]))
    lit, i, lang, n, source = F.lit, F.col("doc_id"), F.col("lang"), F.col("n_chars"), F.col("source")
    text = (
        F.when(k < 3, js(version=lit("2026-01-01"), id=i, language=lang, chars=n.cast("string"))).when(k < 5, js(version=lit("2026-05-01"), doc_id=i, lang=lang, n_chars=n)).when(k == 5, js(version=lit("2026-08-01"), doc_id=i, lang=lang, n_chars=n, source=source))
        .when(k == 6, js(doc_id=i, lang=lang, source=source)).when(k == 7, F.concat(lit('{"doc_id": '), i)).when(k == 8, js(version=lit("2027-01-01"), doc_id=i)).when(k == 9, js(version=lit("2026-05-01"), doc_id=i, lang=lang, more=n, again=n))
        .when(k == 10, js(version=lit("2026-08-01"), doc_id=i, n_chars=n)).otherwise(js(doc_id=lang, lang=lang, source=source))
    )
    rows = S.table(spark, sf, "documents").select(i.alias("key"), text.alias("text"))
    good, aside = versions.split(versions.checked(rows, "text", CHAIN))
    aside = aside.select("key", "version", "reason", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("n_chars", "long"), ("source", "string"))])
    return good.select("key", "version", F.lit(None).cast("string").alias("reason"), "lang", "n_chars", "source").unionByName(aside)


VERSIONED_DOCUMENTS_SQL = """
SELECT doc_id AS key, CASE WHEN k < 3 THEN '2026-01-01' WHEN k IN (3, 4, 9) THEN '2026-05-01' WHEN k NOT IN (7, 8) THEN '2026-08-01' END AS version,
  CASE k WHEN 7 THEN 'no JSON' WHEN 8 THEN 'unknown version 2027-01-01' WHEN 9 THEN 'unknown keys: again, more' WHEN 10 THEN 'missing keys: lang, source' WHEN 11 THEN 'values of another type: doc_id' END AS reason,
  CASE WHEN k < 7 THEN lang END AS lang, CASE WHEN k < 6 THEN n_chars END AS n_chars, CASE WHEN k < 5 THEN 'unknown' WHEN k < 7 THEN source END AS source
FROM (SELECT *, doc_id % 12 AS k FROM documents)
"""

def drift_summaries(spark, sf):
    """Daily summaries in two runs, one day written again; two spans of a fortnight are then compared from them alone."""
    path, date = shared_folder(spark, "summaries"), S.day(F.col("doc_id"))
    words = F.floor(F.col("n_chars") / 6)
    rows = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select(
        date.alias("date"), F.col("source").alias("domain"), F.when(date > "2026-08-14", F.least(words, F.lit(60))).otherwise(words).alias("words"), (F.col("n_chars") % 89 / 89 + F.when(date > "2026-08-14", 0.2).otherwise(0.0)).alias("extractiveness"), F.col("quality").cast("double").alias("hhem")
    )
    for part in (F.col("date") <= "2026-08-20", F.col("date") > "2026-08-20", F.col("date") == "2026-08-03"):
        drift.keep_days(rows.where(part), path)
    return drift.compare_days(drift.kept_days(spark, path), ("2026-08-15", "2026-08-28"), ("2026-08-01", "2026-08-14"))


DRIFT_SUMMARIES_SQL = """
WITH o AS (
  SELECT source AS domain, doc_id % 28 >= 14 AS recent, CASE WHEN doc_id % 28 >= 14 THEN least(n_chars // 6, 60) ELSE n_chars // 6 END AS w, n_chars % 89 / 89 + CASE WHEN doc_id % 28 >= 14 THEN 0.2::DOUBLE ELSE 0 END AS x, quality AS h
  FROM documents JOIN labels USING (doc_id)
),
m AS (SELECT domain, recent, median(w) AS w, median(x) AS x, median(h) AS h FROM o GROUP BY 1, 2),
j AS (SELECT a.domain, a.w AS wn, b.w AS wb, a.x AS xn, b.x AS xb, a.h AS hn, b.h AS hb FROM m a JOIN m b ON a.domain = b.domain AND a.recent AND NOT b.recent)
SELECT domain, 'shorter_sources' AS alert, printf('median source fell from %.0f to %.0f words', round_even(wb, 0), round_even(wn, 0)) AS detail FROM j WHERE wb > 0 AND wn < wb * 0.6::DOUBLE
UNION ALL SELECT domain, 'more_copying', printf('extractiveness rose from %.2f to %.2f', round_even(xb, 2), round_even(xn, 2)) FROM j WHERE xn - xb > 0.15
UNION ALL SELECT domain, 'scoring_chrome', printf('sources shrank %.0f%% while faithfulness held at %.2f', round_even((1 - wn / wb) * 100, 0), hn) FROM j WHERE wb > 0 AND wn < wb * 0.6::DOUBLE AND hn >= hb
"""

def sql_chunks(spark, sf):
    """Lines of documents through a table function in SQL text, which joins the lines of each again."""
    table_functions.register(spark)
    lines = S.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rows = spark.sql("SELECT * FROM text_chunks(TABLE(SELECT doc_id, line, n FROM {lines}) PARTITION BY doc_id ORDER BY n)", lines=lines)
    return rows.select(F.col("key").cast("long").alias("doc_id"), "chunk", "words", F.md5(F.col("text").cast("binary")).alias("md5"))


def stage_log(spark, sf):
    """Three stages over documents, each observed as it is written; the log is read back."""
    log = telemetry.Log(spark, shared_folder(spark, "log"))
    rows, chars = S.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), {"chars": F.sum("n_chars"), "english": F.count_if(F.col("lang") == "en")}
    with log.running("corpus"):
        for name, change in (("read", lambda d: d), ("long", lambda d: d.where("n_chars >= 500")), ("each length", lambda d: d.groupBy("n_chars").agg(F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang")))):
            path = shared_folder(spark, "stage")
            changed = change(rows)
            log.stage(name, changed, lambda df, path=path: df.write.parquet(path), chars)
            rows = spark.read.schema(changed.schema).parquet(path)
    done = telemetry.read_log(spark, log.path).where("name = 'stage.completed'")
    return done.select(F.col("src").alias("stage"), *[F.col("data")[c].cast("long").alias(c) for c in ("rows", "chars", "english")])


STAGE_LOG_SQL = """
WITH long_ AS (SELECT * FROM documents WHERE n_chars >= 500), each_ AS (SELECT n_chars, min(lang) AS lang FROM long_ GROUP BY 1),
told AS (SELECT 'read' AS stage, lang, n_chars FROM documents UNION ALL SELECT 'long', lang, n_chars FROM long_ UNION ALL SELECT 'each length', lang, n_chars FROM each_)
SELECT stage, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (lang = 'en') AS english FROM told GROUP BY 1
"""

QUERIES = (ledger_batches, late_windows, stream_observations, versioned_documents, drift_summaries, sql_chunks, stage_log)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "ledger_batches": "SELECT key, doc_id, lang FROM (SELECT concat_ws('/', source, CAST(n_chars % 5000 AS VARCHAR)) AS key, doc_id, lang, row_number() OVER (PARTITION BY concat_ws('/', source, CAST(n_chars % 5000 AS VARCHAR)) ORDER BY doc_id % 4, doc_id) AS nth FROM documents) WHERE nth = 1",
        "late_windows": LATE_WINDOWS_SQL, "stream_observations": STREAM_OBSERVATIONS_SQL, "versioned_documents": VERSIONED_DOCUMENTS_SQL, "drift_summaries": DRIFT_SUMMARIES_SQL, "sql_chunks": oracles.oracle_sql()["chunk_windows"], "stage_log": STAGE_LOG_SQL,
    }
