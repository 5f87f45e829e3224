"""Requests to a language model and its replies as JSON columns. The call itself is the caller's."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions.text import untrusted_block

REPLY = "choices array<struct<message: struct<content: string>, finish_reason: string>>, usage struct<prompt_tokens: int, completion_tokens: int>"


def user_turn(title: Column, text: Column) -> Column:
    """The article stands inside the fence, nowhere else."""
    return F.concat_ws("\n\n", title, untrusted_block(text))


def request(model: str, system: str, user: Column, max_tokens: int, temperature: float = 0.0, seed: int = 0) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", user)).alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"), F.lit(seed).alias("seed")))


def parsed(reply: Column) -> Column:
    """Struct of content, finish_reason, tokens and hit_the_budget; error is set where there is no choice."""
    body = F.from_json(reply, REPLY)
    first = F.try_element_at(body["choices"], F.lit(1))
    return F.struct(
        first["message"]["content"].alias("content"), first["finish_reason"].alias("finish_reason"), body["usage"]["prompt_tokens"].alias("prompt_tokens"), body["usage"]["completion_tokens"].alias("completion_tokens"),
        (F.coalesce(first["finish_reason"], F.lit("")) == "length").alias("hit_the_budget"), F.when(first.isNull(), "the reply holds no choice").alias("error"),
    )


def scorer_version(scorer: str, revision: str, weights_sha256: str, high: float, medium: float, metrics_version: str = "1") -> str:
    return f"{scorer}@{revision[:8]};weights-{weights_sha256[:8]};metrics-{metrics_version};bands={high:.2f}/{medium:.2f}"


def sampling_spelling(temperature: float, top_p: float, seed: int, max_output_tokens: int, thinking: bool) -> str:
    """One spelling of how a reply was drawn, as an input of the stamp."""
    return f"temperature={temperature:.4f};top_p={top_p:.4f};seed={seed};max_output_tokens={max_output_tokens};thinking={'on' if thinking else 'off'}"


class Runs:
    """Runs in a text that holds JSON arrays or objects one after the other; what is between them is passed over."""

    def eval(self, text: str):
        decoder, seq = json.JSONDecoder(), 0
        begins = re.compile(r"[\[{]")
        found = begins.search(text or "")
        while found:
            own, at = decoder.raw_decode(text, found.start())
            for r in own if isinstance(own, list) else [own]:
                name = str(r.get("model_filename", r.get("model", "?"))).rpartition("/")[2]
                yield name, int(r.get("n_threads", 0)), int(r.get("n_prompt", 0)), int(r.get("n_gen", 0)), float(r["avg_ts"]), float(r.get("stddev_ts", 0.0)), seq
                seq += 1
            found = begins.search(text, at)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark runs of files; ``seq`` keeps their order in a file."""
    schema = "model string, n_threads int, n_prompt int, n_gen int, avg_ts double, stddev_ts double, seq int"
    files = spark.read.text(path, wholetext=True)
    return files.lateralJoin(F.udtf(Runs, returnType=schema)(F.col("value").outer())).drop("value")
