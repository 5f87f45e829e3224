"""From fetched pages to articles, and from model replies to summaries: one ordered gate each, failures stay rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltline.config import Evaluation, Extract
from siltline.functions import canonical
from siltline.functions import text as X
from siltline.functions import urls as U

DRAFT = "summary string, key_points array<string>"


def fetched(pages: DataFrame, robots: DataFrame | None, agent: str, config: Extract = Extract()) -> DataFrame:
    """Applies what is known before and after a fetch to rows of url, status and body: outcome, capped body.

    Reading the network is the caller's: ``pages`` holds what came back. robots: host, robots_txt.
    """
    rows = pages.withColumn("host", U.host(F.col("url")))
    refused = U.why_not_dialable(F.col("url"))
    denied = F.lit(False)
    if robots is not None:
        from siltline.functions.facts import robots_allows

        rows = rows.join(robots, "host", "left")
        denied = ~robots_allows(F.col("robots_txt"), agent, F.col("url"))
    outcome = F.when(refused.isNotNull(), "blocked").when(denied, "robots_denied").otherwise(U.classify_status(F.col("status")))
    body = F.col("body").cast("binary")
    return rows.withColumns({"outcome": outcome, "detail": refused, "body_truncated": F.length(body) > config.body_cap_bytes, "body": F.substring(body, 1, config.body_cap_bytes)})


def to_articles(rows: DataFrame, text: Column, config: Extract = Extract()) -> DataFrame:
    """Adds status, failure_detail, text, word_count, token_count, truncated and truncated_at_tokens.

    rows has title and outcome. An article without a title is set aside, not raised.
    """
    cut = X.truncate_to_tokens(F.col("full_text"), config.truncate_tokens)
    total = F.size(X.split_words(F.coalesce("full_text", F.lit(""))))
    status = (
        F.when(F.col("outcome") != "ok", U.article_status(F.col("outcome")))
        .when(F.col("full_text").isNull() | (total < config.min_source_words), "extract_failed")
        .when(F.col("title").isNull(), "extract_failed")
        .otherwise("ok")
    )
    detail = (
        F.when(F.col("outcome") != "ok", F.col("outcome"))
        .when(F.col("full_text").isNull(), "extractor found no article text")
        .when(total < config.min_source_words, F.format_string("only %d words extracted; page furniture is short", total))
        .when(F.col("title").isNull(), "the page has no title")
    )
    ok = F.col("status") == "ok"
    out = rows.withColumn("full_text", text).withColumns({"status": status, "failure_detail": F.substring(detail, 1, 500), "cut": cut})
    kept = F.when(ok, F.size(X.split_words(F.col("cut.text"))))
    return out.withColumns({
        "text": F.when(ok, F.col("cut.text")), "word_count": kept, "token_count": X.approx_tokens(kept), "truncated": ok & F.col("cut.truncated"),
        "truncated_at_tokens": F.when(ok & F.col("cut.truncated"), X.approx_tokens(F.col("cut.kept_words"))),
    }).drop("cut")


def strict_keys(json: Column, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """Whether the text is a JSON object with all required keys and no others but the optional ones."""
    keys = F.json_object_keys(json)
    return F.coalesce((F.size(F.array_except(F.array(*map(F.lit, required)), keys)) == 0) & (F.size(F.array_except(keys, F.array(*map(F.lit, required + optional)))) == 0), F.lit(False))


def to_summaries(rows: DataFrame, config: Evaluation = Evaluation()) -> DataFrame:
    """rows has article_status, finish_reason and content: adds summary, key_points, status and failure_detail."""
    parts = X.split_thinking(F.col("content"))
    draft = F.from_json("answer", DRAFT)
    out = rows.withColumn("parts", parts).withColumns({"answer": F.col("parts.answer"), "thinking": F.col("parts.thinking")})
    out = out.withColumn("draft", draft)
    shape = strict_keys(F.col("answer"), ("summary", "key_points")) & F.col("draft.summary").isNotNull() & (F.col("thinking") == "")
    words = F.size(X.split_words(F.col("draft.summary")))
    detail = (
        F.when(F.col("article_status") != "ok", "the article did not extract, so there was nothing to summarize")
        .when(F.col("finish_reason") == "length", "the reply was cut off by the output budget, so it never closed its JSON")
        .when(~F.coalesce(shape, F.lit(False)), "the reply did not hold its shape")
        .when(~words.between(config.summary_words_min, config.summary_words_max), F.format_string("summary is %d words, outside the publishable range", words))
    )
    out = out.withColumn("failure_detail", detail)
    ok = F.col("failure_detail").isNull()
    return out.withColumns({"summary": F.when(ok, F.col("draft.summary")), "key_points": F.when(ok, F.col("draft.key_points")), "status": F.when(ok, "ok").otherwise("failed")}).drop("parts", "draft", "thinking", "answer")


def fits_context(tokens: Column, output: int, prompt_words: Column, context: int) -> Column:
    return tokens + output + 2 * prompt_words <= context


PUBLISHED = T.StructType([T.StructField("key_points", T.ArrayType(T.StringType())), T.StructField("summary", T.StringType())])


def output_digest(summary: Column, key_points: Column) -> Column:
    """sha256 of the canonical JSON of the published words alone; a summary that is missing is null in it."""
    points = F.coalesce(key_points, F.array().cast("array<string>"))
    return canonical.digest(F.struct(points.alias("key_points"), summary.alias("summary")), PUBLISHED)


def resolves_to_public(answers: DataFrame) -> DataFrame:
    """host, public: whether every address that a host's name led to is global. answers: host, address (null: no answer)."""
    from siltline.functions.facts import address_is_global

    return answers.select("host", address_is_global(F.col("address")).alias("ok")).groupBy("host").agg(F.min(F.coalesce("ok", F.lit(False))).alias("public"))


def fetched_with_retries(pages: DataFrame, attempts: DataFrame, robots: DataFrame, answers: DataFrame, agent: str, config: Extract = Extract()) -> DataFrame:
    """One outcome per row of ``pages`` (url) from what every attempt gave: url, n from 0, status and body.

    The gate goes first: dialable, robots (a host without a text is a no), public addresses. Then the
    first attempt that is no transient failure counts, else the last one within the retries; an address
    never tried is transient. ``waited`` is the sum of the pauses before that attempt.
    """
    from siltline.functions.facts import robots_allows

    tried = attempts.where(F.col("n") <= config.max_retries).withColumn("outcome", U.classify_status(F.col("status")))
    final = F.min_by(F.struct("n", "status", "outcome", "body"), F.when(F.col("outcome") == "transient", 1000 - F.col("n")).otherwise(F.col("n")))
    rows = pages.withColumn("host", U.host(F.col("url"))).join(robots, "host", "left").join(resolves_to_public(answers), "host", "left").join(tried.groupBy("url").agg(final.alias("last")), "url", "left")
    refused, unknown = U.why_not_dialable(F.col("url")), F.col("robots_txt").isNull()
    denied = ~F.coalesce(robots_allows(F.col("robots_txt"), agent, F.col("url")), F.lit(False))
    inward = ~F.coalesce("public", F.lit(False))
    outcome = F.when(refused.isNotNull(), "blocked").when(unknown | denied, "robots_denied").when(inward, "blocked").otherwise(F.coalesce("last.outcome", F.lit("transient")))
    detail = (
        F.when(refused.isNotNull(), refused).when(unknown, "robots.txt could not be read").when(denied, "robots.txt disallows this path").when(inward, "address is not on the public internet")
        .when(F.col("last").isNull(), "never attempted").when(F.col("last.outcome") != "ok", F.concat(F.lit("HTTP "), F.col("last.status")))
    )
    reached = F.when(~(refused.isNotNull() | unknown | denied | inward), F.col("last"))
    body = F.when(reached["outcome"] == "ok", reached["body"].cast("binary"))
    waits = F.slice(U.backoff_delays(config.backoff_initial_seconds, config.backoff_multiplier, config.max_retries), F.lit(1), F.coalesce(reached["n"], F.lit(0)).cast("int"))
    return rows.withColumns({
        "outcome": outcome, "detail": detail, "status": reached["status"], "body_truncated": F.coalesce(F.length(body) > config.body_cap_bytes, F.lit(False)), "body": F.substring(body, 1, config.body_cap_bytes), "waited": F.aggregate(waits, F.lit(0.0), lambda a, x: a + x),
    }).drop("last", "robots_txt", "public", "host")
