"""A training-data pipeline over documents: stages written as Parquet, each read by the next.

Quality and toxicity drop what they reject, near-duplicate detection keeps one document of each
group, and packing returns pieces in sequences. A document is dropped by its own text alone in the
first two stages; in the third it goes if its group has a smaller id. Rows with one id are one
document: they stay or go together. Rows without an id stay unless a copy with an id does. Null and empty
texts are documents like others to all stages. Every stage reads very long texts whole, in the memory of the
task that holds them; further columns of documents pass through to the last stage. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.llm.common import fold, saved, table
from siltline.llm.minhash import BROADCAST_IDS, near_duplicates
from siltline.llm.packing import pack_documents
from siltline.llm.quality import score_quality, train_quality
from siltline.llm.toxicity import learn_toxicity, score_toxicity
from siltline.llm.wordbpe import vocabulary_path

MARK = "siltline_score"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    crf = train_quality(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", fold("k", 4) != 2)
    return score_quality(docs, "text", crf, docs.columns, MARK).where(F.col(MARK) >= 0.7).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = learn_toxicity(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", fold("k", 5) != 0)
    return score_toxicity(docs, "text", net, docs.columns, MARK).where(F.col(MARK) < 0.5).select(*docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = saved(near_duplicates(docs, "doc_id", "text").where("NOT kept").select("doc_id").distinct(), "dropped")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, "doc_id", "text", vocabulary_path())


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near-duplicates", duplicates_stage), ("packing", packing_stage)]
#: Learned scores cannot be put in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
