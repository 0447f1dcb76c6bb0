"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame, each by one operator of this package.

All but the last return the columns of ``docs``; extra columns go along, rows that stay stay as they are
but for masked secrets. Each stage reads the whole of what its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import packing as packs
from siftwell.llm import jaccard, quality, secrets
from siftwell.llm import toxicity as toxic
from siftwell.llm.common import with_row
from siftwell.session import bound_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and lie inside their language's perplexity band."""
    bound_batches(spark)
    return quality.keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model learns from the labels of documents still there."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxic.train(docs, labels)
    return toxic.score(with_row(docs, "text"), model, keep=["_row"], drop_toxic=True).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest doc_id; texts are near
    when the Jaccard similarity of their five-word shingles is 0.8 or more."""
    bound_batches(spark)
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secrets.mask(docs, F.col("doc_id"), F.col("source"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2,048 tokens."""
    bound_batches(spark)
    return packs.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
