"""Token counts through a digest cache (operator 7).

The cache is a Parquet folder of (content, tokenizer, n_tokens): digests of the text and of the vocabulary
file with its settings. Counting joins digests to the cache, encodes each missing content once, appends
what it found, and joins again. Appends go to a folder of their own, so a repeated job adds no duplicate
that a reader would see twice.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import per_batch, texts, whole
from siftwell.llm.vocab import ByteLevel, read_bytes

CACHE = "content string, tokenizer string, n_tokens bigint"


def tokenizer_digest(file: bytes, pattern: str) -> str:
    return hashlib.sha256(file + b"\0" + pattern.encode()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an absent folder is an empty cache. Contents stored twice count once."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(CACHE).option("recursiveFileLookup", "true").parquet(cache) if there \
        else spark.createDataFrame([], CACHE)
    return rows.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, vocabulary: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text, any more columns) -> doc_id, n_bytes, n_tokens, one row for each row.

    Null texts count as empty (0 bytes, 0 tokens); repeated rows give repeated rows; an empty table gives
    none. Equal texts are brought together by digest, after each task has dropped its own repeats, so a
    text with very many copies arrives once per task.
    """
    spark = docs.sparkSession
    file = read_bytes(vocabulary)
    tokenizer, shipped = tokenizer_digest(file, pattern), spark.sparkContext.broadcast(file)
    keyed = docs.select("doc_id", whole(F.col("text")).alias("text"))
    keyed = keyed.withColumn("content", F.sha2("text", 256)).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    known = read_cache(spark, cache).where(F.col("tokenizer") == tokenizer)
    misses = keyed.select("content", "text").dropDuplicates(["content"]).join(known.select("content"), "content", "left_anti")

    def make():
        coder = ByteLevel(shipped.value, pattern)
        return lambda batch: {"n_tokens": [len(coder.ids(t)) for t in texts(batch)]}

    found = per_batch(misses, make, "n_tokens bigint", keep=["content"])
    found.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens") \
        .write.parquet(f"{cache}/run-{uuid.uuid4().hex}")
    counts = read_cache(spark, cache).where(F.col("tokenizer") == tokenizer).select("content", "n_tokens")
    return keyed.select("doc_id", "content", "n_bytes").join(counts, "content").select("doc_id", "n_bytes", "n_tokens")
