"""From raw documents to token ids: toxicity, recurring lines, near copies, source weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as
Parquet in the shared folder and hands the table that it reads back to the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pointloom.llm.byte_bpe import encode_documents
from pointloom.llm.common import table
from pointloom.llm.line_dedup import drop_recurring_lines
from pointloom.llm.mixing import mix_documents
from pointloom.llm.near_dedup import one_of_each
from pointloom.llm.toxicity import score_documents, train
from pointloom.session import scratch_folder, small_batches

#: Columns of ``documents``; every stage but the last returns them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the classifier, fitted on the labelled ones among them, calls toxic."""
    small_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines whose template an earlier document has; a document of which nothing is left goes."""
    small_batches(spark)
    cut = drop_recurring_lines(docs, keep=("lang", "source"), short=True).where("has_text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    small_batches(spark)
    return one_of_each(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: a row for each document and pass."""
    return mix_documents(docs).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    small_batches(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: A learnt classifier and a vocabulary's merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's table."""
    folder = scratch_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
