"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.llm.common import fold, held_out, table
from siltline.llm.wordbpe import vocabulary_path


#: A vector takes part if all its components are finite numbers.
TOP_K_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path())


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.sentence_pieces import round_trips

    done = round_trips(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path("piece_bpe_32k.model"))
    return done.select(F.col("key").alias("doc_id"), F.col("n_ids").alias("n_tokens"), "ids_crc32", "text_crc32", "same")


def op4_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.vector_dups import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.toxicity import learn_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    net = learn_toxicity(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", fold("k", 5) != 0)
    scored = score_toxicity(docs, "text", net, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.quality import score_quality, train_quality

    docs = table(spark, sf_dir, "documents")
    crf = train_quality(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", fold("k", 4) != 2)
    scored = score_quality(docs, "text", crf, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path(), end=1)
    return read_token_files(files).select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.lm import score_texts

    scored = score_texts(table(spark, sf_dir, "documents"), "doc_id", "text", fold("k", 5) != 1)
    return scored.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.conversations import damage_conversations, repair_conversations

    rows = table(spark, sf_dir, "conversations")
    damaged = damage_conversations(rows, "conv_id", "turn", "role", "text")
    repaired = repair_conversations(damaged, "conv", "turn", "role", "text", rows.select(F.col("conv_id").alias("conv")))
    return repaired.withColumnRenamed("conv", "conv_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.fill_middle import fill_in_middle, restore_texts

    done = restore_texts(fill_in_middle(table(spark, sf_dir, "documents"), "doc_id", "text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.llm.sharding import interleaved_shards

    return interleaved_shards(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_minhash, op3_sentence_pieces, op4_vector_duplicates, op5_toxicity, op6_top_k, op7_quality, op8_token_files, op9_licenses, op10_language_model, op11_conversation_repair, op12_fill_in_middle, op13_sharding]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others learn, tokenise or hash; their tests compare with brute force or round trips."""
    from siltline.llm.fill_middle import FILL_MIDDLE_SQL
    from siltline.llm.licenses import oracle

    return {"op6_top_k": TOP_K_SQL, "op9_licenses": oracle(), "op12_fill_in_middle": FILL_MIDDLE_SQL}
