"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.config import Extract
from siltline.functions import text as T
from siltline.functions import urls as U
from siltline.functions import vectors as V
from siltline.operators import articles, assemble, boards, checks, corpus, decide, digest, drift, ledger, metrics, models, rank, retention, route, search
from siltline.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 4


def _live(spark, sf):
    return S.candidates(spark, sf).groupBy("vertical").agg(F.count_distinct("source_id").alias("live_feeds"))


def _scored(spark, sf):
    rows = S.candidates(spark, sf)
    return rank.scored(rank.stories(rows), S.every_tenth(rows, 7), S.every_tenth(rows, 3))


def plan_day(spark, sf):
    return rank.planned(_scored(spark, sf), S.verticals(spark, sf), _live(spark, sf))


def vertical_plan(spark, sf):
    return rank.vertical_plans(rank.stories(S.candidates(spark, sf)), plan_day(spark, sf), S.verticals(spark, sf), _live(spark, sf))


def shard_assignment(spark, sf):
    return rank.shard_of(plan_day(spark, sf), SHARDS)


def visual_ordinals(spark, sf):
    items = plan_day(spark, sf).withColumn("kind", F.when(F.col("carried_by") > 1, "chart").otherwise("none"))
    return rank.visual_ordinals(items).select("day", "item_id", "kind", "visual_ordinal")


def url_canonical(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", U.canonicalise(F.col("url")).alias("canonical_url"), U.url_key(U.canonicalise(F.col("url"))).alias("url_key"))


def url_dedupe(spark, sf):
    rows = url_canonical(spark, sf)
    return rows.groupBy("url_key", "canonical_url").agg(F.count("*").alias("carried_by"), F.min("page_id").alias("first_page"))


def url_dialable(spark, sf):
    why = U.why_not_dialable(F.col("url"))
    return S.table(spark, sf, "pages").select("page_id", why.isNull().alias("dialable"), why.alias("reason"), U.robots_url(F.col("url")).alias("robots_url"))


def host_rollup(spark, sf):
    return S.table(spark, sf, "pages").groupBy(U.domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


def word_counts(spark, sf):
    t = F.col("text")
    return S.table(spark, sf, "documents").select("doc_id", T.word_count(t).alias("words"), F.size(T.split_words(t)).alias("split_words"), T.approx_tokens(F.size(T.split_words(t))).alias("tokens"))


def lead_text(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", T.lead(F.col("text")).alias("lead"))


def compression(spark, sf):
    return S.pairs(spark, sf).select("doc_id", F.bround(T.compression(F.col("summary"), F.col("source_text")), 6).alias("compression"))


def extractiveness(spark, sf):
    return S.pairs(spark, sf).select("doc_id", F.bround(T.extractiveness(F.col("summary"), F.col("source_text")), 6).alias("extractiveness"))


def verbatim_run(spark, sf):
    return S.pairs(spark, sf).select("doc_id", F.bround(T.verbatim_run(F.col("summary"), F.col("source_text")), 6).alias("verbatim_run"))


def unsupported_numbers(spark, sf):
    return S.pairs(spark, sf).select("doc_id", T.unsupported_numbers(F.col("summary"), F.col("source_text")).alias("unsupported_numbers"))


def hedge_dropped(spark, sf):
    return S.pairs(spark, sf).select("doc_id", T.hedge_dropped(F.col("summary"), F.col("source_text")).alias("hedge_dropped"))


def lead_coverage(spark, sf):
    return S.pairs(spark, sf).select("doc_id", F.bround(T.lead_coverage(F.col("summary"), F.col("source_text")), 6).alias("lead_coverage"))


def entities(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.explode(T.entities(T.lead(F.col("text")))).alias("entity"))


def counterweight_band(spark, sf):
    return S.pairs(spark, sf).select("doc_id", metrics.counterweight_band(F.col("summary"), F.col("source_text")).alias("band"))


def _evals(spark, sf):
    rows = S.pairs(spark, sf).join(S.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    full = F.col("quality") * 0.45 + F.col("doc_id") % 10 * 0.05
    return metrics.eval_rows(rows, full + F.col("doc_id") % 3 * 0.06, full)


def eval_row(spark, sf):
    rounded = [F.bround(c, 6).alias(c) for c in ("hhem", "hhem_full", "hhem_delta", "coverage", "compression", "extractiveness", "verbatim_run")]
    plain = ("doc_id", "truncation_flagged", "unsupported_numbers", "hedge_dropped", "source_word_count", "source_seen_word_count", "summary_word_count", "band")
    return _evals(spark, sf).select(*plain, *rounded)


def chunk_scores(spark, sf):
    """A scorer that each task loads, over windows: the largest window counts."""
    rows = metrics.score_over_chunks(S.pairs(spark, sf), models.scorer(models.overlap), "doc_id")
    return rows.select("doc_id", F.bround("score", 6).alias("score"))


def band_edges(spark, sf):
    return metrics.band_edges(S.ledger(spark, sf).select(F.bround("hhem", 6).alias("hhem")), "hhem")


def _banded(spark, sf):
    return S.ledger(spark, sf).withColumn("band", metrics.band(F.bround("hhem", 6), F.col("toxic")))


def band_by_date(spark, sf):
    return boards.bands_by_date(_banded(spark, sf))


def console_day(spark, sf):
    return boards.console_days(_banded(spark, sf))


def console_worst(spark, sf):
    return boards.worst_stage(console_day(spark, sf))


def _published(spark, sf):
    """Items of the plan without those of the two lowest scores of each day; banded by score."""
    items = plan_day(spark, sf).where("ordinal <= 3")
    return items.withColumn("band", F.when(F.col("rank_score") >= 2, "high").when(F.col("rank_score") >= 1, "medium").otherwise("low"))


def _runs(spark, sf):
    """Two runs a day: how many items each vertical pair added."""
    rows = _published(spark, sf).withColumn("n", (F.col("ordinal") % 2 + 1).cast("int"))
    return rows.groupBy("day", "n").agg(F.count("*").alias("items_added"))


def archive_days(spark, sf):
    counters = digest.day_counters(plan_day(spark, sf), _published(spark, sf))
    return boards.archive(_published(spark, sf), counters)


def day_notice(spark, sf):
    return boards.day_notice(_published(spark, sf), _runs(spark, sf))


def day_paging(spark, sf):
    return boards.paging(plan_day(spark, sf))


def latest_date(spark, sf):
    return boards.latest_date(plan_day(spark, sf))


def corpus_shape(spark, sf):
    t = F.col("text")
    rows = S.table(spark, sf, "documents").select(F.size(T.split_words(t)).alias("words"), F.when(F.col("n_chars") < 100, "extract_failed").otherwise("ok").alias("status"))
    return corpus.corpus_shape(rows, "status", "words")


def boilerplate_ratio(spark, sf):
    return corpus.boilerplate(S.table(spark, sf, "documents"), "source", "doc_id", "text")


def cost_report(spark, sf):
    """Suppliers as models: speeds measured on their line items stand for throughputs."""
    rows = S.table(spark, sf, "lineitem").select(
        F.concat(F.lit("m"), F.col("l_suppkey") % 3).alias("model"), (F.col("l_linenumber") * 700).alias("n_prompt"), F.lit(0).alias("n_gen"), (F.col("l_quantity") + 1).alias("avg_ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    )
    rows = rows.groupBy("model", "n_prompt", "n_gen", "seq").agg(F.max("avg_ts").alias("avg_ts"))
    prefill = corpus.throughputs(rows).where("kind = 'prefill'").select("model", "size", "speed")
    decode_ = prefill.groupBy("model").agg(F.min("speed").alias("decode_speed"))
    buckets = spark.createDataFrame([("short", 411, 0.5, 150), ("medium", 1546, 0.25, 200), ("long", 2769, 0.25, 250)], "bucket string, words int, share double, output_tokens int")
    return corpus.cost_report(prefill, decode_, buckets, articles=17, parallel=4)


def _observations(spark, sf):
    t = F.col("source_text")
    rows = S.pairs(spark, sf).join(S.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return rows.select("doc_id", F.col("source").alias("domain"), T.word_count(t).alias("words"), T.extractiveness(F.col("summary"), t).alias("extractiveness"), F.col("quality").cast("double").alias("hhem"))


def drift_alerts(spark, sf):
    """Runs of twenty ids by turns: of the later ones' pages only 100 words were read."""
    rows = _observations(spark, sf).withColumn("turn", F.floor(F.col("doc_id") / 20) % 2)
    later = rows.where("turn = 1").withColumn("words", F.least("words", F.lit(100)))
    return drift.compare(later, rows.where("turn = 0"))


def extraction_rot(spark, sf):
    return drift.rot(S.ledger(spark, sf), "source", F.col("hhem") >= 0.5)


def _measurements(spark, sf):
    rows = S.ledger(spark, sf).select(F.concat(F.lit("model-"), "lang").alias("model_id"), F.lit(0.9).alias("leaderboard_hhem"), F.bround("hhem", 6).alias("hhem"))
    place = F.when(F.col("model_id") == "model-de", 0).when(F.col("model_id") == "model-en", 1).when(F.col("model_id") == "model-es", 2).otherwise(3)
    return decide.measured(rows).withColumn("position", place)


def validation_decide(spark, sf):
    rows = _measurements(spark, sf)
    return decide.to_rows(rows, decide.decide(rows, "model-en"), "model-en")


def _stamps(spark, sf, year):
    """Orders as items: one stamp per customer, priorities and status as the inputs of the stamp."""
    rows = S.table(spark, sf, "orders").where(F.year("o_orderdate") % 2 == year)
    last = rows.groupBy(F.col("o_custkey").alias("item")).agg(F.max_by(F.struct("o_orderpriority", "o_orderstatus"), "o_orderkey").alias("x"))
    stamp = ledger.fingerprint({"priority": (F.col("x.o_orderpriority"), "string"), "sampler": (F.lit("greedy"), "string")})
    return last.select("item", stamp.alias("fingerprint"), F.when(F.col("x.o_orderstatus") != "P", F.sha2("x.o_orderstatus", 256)).alias("output_digest"))


def fingerprint_classify(spark, sf):
    return ledger.classify(_stamps(spark, sf, 1), _stamps(spark, sf, 0), "item")


def ledger_append(spark, sf):
    rows = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderpriority")
    known = rows.where("o_orderpriority = '1-URGENT'").select("key").distinct()
    return ledger.append_new(rows.where("o_orderpriority <> '1-URGENT'").drop("o_orderpriority"), known, "key", "o_orderkey")


def _items_of(spark, sf, rest):
    return plan_day(spark, sf).where(F.col("ordinal") % 2 == rest).select("day", "item_id", "vertical", "url_key", F.row_number().over(_by_plan()).alias("position"))


def _by_plan():
    from pyspark.sql import Window

    return Window.partitionBy("day").orderBy("vertical", "ordinal")


def digest_append(spark, sf):
    plan = plan_day(spark, sf)
    place = F.row_number().over(_by_plan()).alias("position")
    previous = plan.where("ordinal <= 2").select("day", "item_id", "vertical", place).withColumn("introduced_by_run", F.lit(1))
    now = plan.where("ordinal >= 2").select("day", "item_id", "vertical", place)
    return digest.append_items(previous, now, 2)


def run_manifest(spark, sf):
    plan = plan_day(spark, sf)
    status = F.when(F.col("carried_by") > 1, "ok").when(F.col("tier") == 3, "skipped").otherwise("failed")
    summaries = plan.select("day", "item_id", status.alias("status"), F.concat(F.lit("fp-"), "tier").alias("fingerprint"))
    return digest.manifests(plan, summaries, _published(spark, sf), 1)


def vertical_counts(spark, sf):
    return digest.vertical_counts(_published(spark, sf))


def search_topk(spark, sf):
    """Every vector whose number is divisible by 100 asks all."""
    rows = S.table(spark, sf, "embeddings")
    items = rows.select(F.format_string("item-%06d", "vec_id").alias("item_id"), S.day(F.col("vec_id")).alias("date"), "embedding")
    return search.rank_each(items, rows.where("vec_id % 100 = 0").select("vec_id", "embedding"), "embedding", "date", "item_id", "vec_id")


def vector_roundtrip(spark, sf):
    rows = S.table(spark, sf, "embeddings").withColumn("text", V.quantise(F.col("embedding")))
    rows = rows.withColumn("back", V.dequantise(F.col("text")))
    return rows.select("vec_id", "text", F.bround(V.dot(F.col("back"), F.col("embedding")), 5).alias("kept"))


def chunk_windows(spark, sf):
    rows = S.table(spark, sf, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "window"))
    return rows.select("doc_id", "chunk", F.size(T.split_words(F.col("window"))).alias("words"), F.md5(F.col("window").cast("binary")).alias("md5"))


def truncate_tokens(spark, sf):
    cut = T.truncate_to_tokens(F.col("text"), 500)
    rows = S.table(spark, sf, "documents").select("doc_id", cut.alias("cut"))
    return rows.select("doc_id", "cut.truncated", "cut.kept_words", F.md5(F.col("cut.text").cast("binary")).alias("md5"))


def text_filter(spark, sf):
    t = F.col("text")
    hit = T.contains_needle(" License ", T.lead(t, 1), t, T.sentences(t))
    return S.table(spark, sf, "documents").where(hit).select("doc_id", "source")


def status_classify(spark, sf):
    status = (F.col("o_orderkey") % 600).cast("int")
    rows = S.table(spark, sf, "orders").select("o_orderkey", status.alias("status"), U.classify_status(status).alias("outcome"))
    return rows.withColumn("article_status", U.article_status(F.col("outcome")))


def retention_report(spark, sf):
    """Pages as published files by date."""
    when = F.date_add(F.lit("2025-01-01").cast("date"), (F.col("page_id") % 600).cast("int"))
    rows = S.table(spark, sf, "pages").select(
        F.concat(F.date_format(when, "yyyy/MM/dd"), F.lit("/"), F.col("page_id"), F.when(F.col("page_id") % 3 == 0, ".svg").when(F.col("page_id") % 3 == 1, ".PNG").otherwise(".json")).alias("path"), F.octet_length("html").cast("long").alias("length")
    )
    return retention.prune_report(rows, F.lit("2026-08-22").cast("date"), 6, False, 50).crossJoin(retention.site_size(rows))


def sanitize_text(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", F.md5(T.sanitize(F.col("html")).cast("binary")).alias("md5"), F.length(T.sanitize(F.col("html"))).alias("length"))


def page_text(spark, sf):
    from siltline.functions.pages import main_text

    rows = S.table(spark, sf, "pages").select("page_id", "url", F.lit("ok").alias("outcome"), main_text(F.col("html")).alias("body"))
    rows = rows.withColumn("title", T.clean_title(F.substring_index("body", "\n", 1)))
    done = articles.to_articles(rows, F.col("body"))
    return done.select("page_id", "title", "status", "failure_detail", "word_count", "token_count", "truncated", F.md5(F.col("text").cast("binary")).alias("md5"))


def numeric_facts(spark, sf):
    from siltline.functions.facts import numeric_facts as facts

    rows = S.table(spark, sf, "documents").select("doc_id", F.posexplode(facts(F.col("text"))).alias("position", "fact"))
    return rows.select("doc_id", "position", F.col("fact.value").cast("double").alias("value"), "fact.raw", "fact.unit", "fact.context")


def same_unit_bars(spark, sf):
    """Line items of an order as points, their return flag as the unit."""
    rows = S.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))).alias("x"))  # 7 lines at most
    facts = F.transform("x", lambda p: F.struct(p["l_quantity"].alias("value"), p["l_returnflag"].alias("unit")))
    points = F.transform("x", lambda p, i: F.struct(F.concat(F.lit("line "), p["l_linenumber"]).alias("label"), i.alias("fact_index")))
    bars = route.same_unit_bars(F.col("points"), F.col("facts"))
    rows = rows.withColumns({"facts": facts, "points": points}).withColumn("bars", bars)
    return rows.select("l_orderkey", F.element_at("bars", 1)["unit"].alias("unit"), F.size("bars").alias("bars"), route.common_unit(F.col("points"), F.col("facts")).alias("common_unit"))


def integrity_violations(spark, sf):
    plan = plan_day(spark, sf)
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.when(F.col("n_chars") >= 200, "ok").otherwise("failed").alias("status"), "text", F.when(F.col("n_chars") < 300, None).otherwise("t").alias("title"), F.lit(None).cast("string").alias("failure_detail"), F.lit(False).alias("truncated"), F.lit(None).cast("int").alias("truncated_at_tokens"))
    return checks.violations(checks.check_plan(plan), checks.check_articles(docs, "key"), checks.check_eval(_evals(spark, sf), "doc_id"), checks.repeated(S.table(spark, sf, "orders"), "orders", ["o_custkey", "o_orderstatus", "o_orderpriority"], "one order of a kind"))


def event_sessions(spark, sf):
    """Events of each user that lie less than an hour apart."""
    from siltline.streaming.append import sessions

    rows = sessions(S.table(spark, sf, "events"), "ts", "user_id", "1 hour")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


def stream_deduplicated(spark, sf):
    """Events streamed; of each user and type the first within the watermark's day or more passes: as many keys as the table has."""
    from siltline.sources.shared import shared_folder
    from siltline.streaming.append import deduplicated

    path, state = shared_folder(spark, "stream-first"), shared_folder(spark, "stream-state")
    stream = spark.readStream.schema(S.table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet").withColumns({"key": F.concat_ws("/", "user_id", "event_type"), "ts": F.col("ts").cast("timestamp")})
    deduplicated(stream, "key", "ts", "3650 days").select("key").writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string").parquet(path)


def event_windows(spark, sf):
    from siltline.streaming.append import window_counts

    rows = window_counts(S.table(spark, sf, "events").select("ts", "event_type", F.lit(1.0).alias("value")), "ts", "event_type", "1 day")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def summary_gate(spark, sf):
    """Assistant turns as replies in the shape asked for; every fifth was cut off, every seventh article had failed."""
    body = F.to_json(F.struct(F.col("text").alias("summary"), F.array().cast("array<string>").alias("key_points")))
    rows = S.table(spark, sf, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", F.when(F.col("conv_id") % 7 == 0, "failed").otherwise("ok").alias("article_status"), F.when(F.col("conv_id") % 5 == 0, "length").otherwise("stop").alias("finish_reason"), body.alias("content")
    )
    return articles.to_summaries(rows).select("conv_id", "turn", "status", "failure_detail", F.md5(F.col("summary").cast("binary")).alias("md5"))


def fetch_outcome(spark, sf):
    rows = S.table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") % 600).cast("int").alias("status"), F.col("html").alias("body"))
    done = articles.fetched(rows, None, "agent", Extract(body_cap_bytes=2000))
    return done.select("page_id", "outcome", "body_truncated", F.length("body").alias("bytes"), U.article_status(F.col("outcome")).alias("article_status"))


def route_decide(spark, sf):
    """Orders as items: a chart of their lines' quantities, a chain of their flags, or none, by the order's number."""
    rows = S.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))).alias("x"))  # 7 lines at most
    facts = F.transform("x", lambda p: F.struct(p["l_quantity"].cast("decimal(38,10)").alias("value"), p["l_quantity"].cast("string").alias("raw"), p["l_returnflag"].alias("unit"), F.lit("").alias("context")))
    points = F.transform("x", lambda p, i: F.struct(F.concat(F.lit("line "), p["l_linenumber"]).alias("label"), i.alias("fact_index")))
    n = F.col("l_orderkey") % 4
    rows = rows.select(
        "l_orderkey", F.lit("ok").alias("summary_status"), F.when(F.col("l_orderkey") % 11 == 0, "length").otherwise("stop").alias("finish_reason"), F.lit(True).alias("shape_ok"),
        F.when(n == 0, "none").when(n == 1, "diagram").otherwise("chart").alias("kind"), points.alias("points"), F.transform("x", lambda p: p["l_returnflag"]).alias("steps"), F.lit("cap").alias("caption"), F.lit("dull").alias("reason"), facts.alias("facts"),
    )
    return route.to_routes(rows).select("l_orderkey", "kind", "rationale", "spec_format", F.when(F.col("spec_format") == "mermaid", F.md5(F.col("spec").cast("binary"))).alias("md5"))


def stream_append(spark, sf):
    """Events streamed into a ledger that keeps one row per user and type; a second run over the same input adds none."""
    from siltline.sources.journal import Journal
    from siltline.sources.shared import shared_folder
    from siltline.streaming.append import append_stream

    schema = S.table(spark, sf, "events").schema
    path, state = shared_folder(spark, "stream-ledger"), shared_folder(spark, "stream-state")
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn("key", F.concat_ws("/", "user_id", "event_type"))
        append_stream(stream.select("key", "event_id"), path, state, "key", "event_id").awaitTermination()
    return Journal(spark, path).read("rows", "key string, event_id long")


def assembled_items(spark, sf):
    """Planned items; stories of several sources have summaries, odd numbers scores, first-tier stories visuals."""
    plan, key = plan_day(spark, sf), assemble.KEY
    own = plan.select(*key, "carried_by", "ordinal", "tier", "rank_score")
    summaries = own.where("carried_by > 1").select(*key, F.concat(F.lit("summary of "), "item_id").alias("summary"))
    evals = own.where("ordinal % 2 = 1").select(*key, F.when(F.col("rank_score") >= 2, "high").otherwise("low").alias("eval_band"))
    routes = own.where("tier = 1").select(*key, F.lit("chart").alias("kind"), F.concat(F.lit("v/"), "item_id").alias("path"))
    rows = assemble.joined(plan, own.select(*key), summaries, evals, routes)
    sources = plan.where("source_id % 2 = 0").select("source_id", F.concat(F.lit("user "), "source_id").alias("source_name"), F.lit("community").alias("source_kind")).distinct()
    rows = assemble.with_vertical(assemble.with_source(rows, sources), S.verticals(spark, sf))
    drawn = assemble.visual(F.col("kind"), F.col("path"), F.lit("alt"), F.lit("absent"))
    return rows.select("day", "item_id", "display_name", "source_name", "source_kind", assemble.band_or_fallback(F.col("eval_band"), F.lit("medium")).alias("band"), assemble.text_for(F.col("item_id"), F.col("summary")).alias("text"), drawn["path"].alias("visual_path"))


QUERIES: tuple[Query, ...] = (
    plan_day, vertical_plan, shard_assignment, visual_ordinals, url_canonical, url_dedupe, url_dialable, host_rollup, word_counts, lead_text, compression, extractiveness, verbatim_run, unsupported_numbers, hedge_dropped, lead_coverage, entities,
    counterweight_band, eval_row, chunk_scores, band_edges, band_by_date, console_day, console_worst, archive_days, day_notice, day_paging, latest_date, corpus_shape, boilerplate_ratio, cost_report, drift_alerts, extraction_rot, validation_decide,
    fingerprint_classify, ledger_append, digest_append, run_manifest, vertical_counts, search_topk, vector_roundtrip, chunk_windows, truncate_tokens, text_filter, status_classify, retention_report, sanitize_text, page_text, numeric_facts,
    same_unit_bars, integrity_violations, event_windows, event_sessions, stream_deduplicated, summary_gate, fetch_outcome, route_decide, stream_append, assembled_items,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}
