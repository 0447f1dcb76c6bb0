"""The corpus pipeline: stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import stages
from siftwell.llm.common import stored
from siftwell.session import use_utc

#: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("quality_rules", stages.quality_rules),
    ("toxicity", stages.toxicity),
    ("near_dedup", stages.near_dedup),
    ("secret_scan", stages.secret_scan),
    ("packing", stages.packing),
]

#: Model scores and token ids are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's result is stored in the shared folder for the next."""
    use_utc(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
