"""From raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns what its decisions leave. All but the last return the columns of
documents. run() writes every stage's result as Parquet in the shared folder and reads it again as the next one's docs.

In all stages: a null text is an empty one; rows without an id go through every stage and are never copies of others; rows
of one id are judged each by itself, but for the Jaccard join, where they are one document; an empty table gives an empty
one; columns of documents other than doc_id, text, lang, source and n_chars are left behind by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, line_templates, neardup, quality
from tidemark.llm.folders import scratch
from tidemark.llm.graph import with_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Without labels of both kinds none does."""
    return quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the document with the smallest id; every document stays, a null text stays
    null, n_chars follows the text."""
    out = line_templates.drop_recurring(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of copies and near copies the document with the smallest id stays; rows without an id stay. Rows of one
    id stay or go together: they go if one of them is in the class of a smaller id."""
    classes = neardup.near_duplicates(docs)[0]
    return with_ids(docs, classes.where("doc_id <> class_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.flagged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)
    return found.where("not contaminated").select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and whether decoding them gives the text back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, keep=["text", "lang", "source"]).select(
        "doc_id", "lang", "source", "n_tokens", "ids_sha256", (F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")), 256)).alias("round_trip")
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", byte_bpe),
]
#: No stage before the last can be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
