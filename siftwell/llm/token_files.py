"""Token ids as ORC files in document order (operator 6).

Ids are an integer array column, so ORC stores them run-length encoded; stripes are small enough that one
file is read by many tasks; row indexes and Bloom filters on doc_id let a reader skip row groups. Files
follow each other by document: the range of doc_id they hold grows with ``part``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import conf, per_batch
from siftwell.llm.vocab import WordLevel, read_bytes

ORC = {
    "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd",
}


def list_column(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows).astype("i4") if rows else np.empty(0, "i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, parts: int | None = None) -> None:
    """Write doc_id, n_tokens, token_ids of all ``docs`` (doc_id, text; more columns are dropped) to ``path``.

    A null text is an empty one, a document without a doc_id comes first, rows that repeat a doc_id are
    neighbours (shorter first). Texts are encoded once: ranges of doc_id are found from that column alone.
    """
    spark = docs.sparkSession
    parts = parts or conf(spark, "spark.sql.shuffle.partitions", "200")
    shares = [i / parts for i in range(1, parts)]
    cuts = docs.select(F.percentile_approx("doc_id", shares, 100 * parts)).head()[0] if shares else None
    cuts = np.array(sorted(set(cuts or [])), "i8")
    file = spark.sparkContext.broadcast(read_bytes(vocabulary))

    def make():
        coder = WordLevel(file.value)
        end = np.array([end_id], "<u4")

        def work(batch):
            ids = [np.concatenate([i, end]) for i in coder.each(batch.column("text"))]
            keys = batch.column("doc_id").fill_null(-(2 ** 63)).to_numpy(zero_copy_only=False)
            return {"n_tokens": [len(i) for i in ids], "token_ids": list_column(ids),
                    "part": np.searchsorted(cuts, keys, side="right").astype("i4")}

        return work

    encoded = per_batch(docs.select("doc_id", "text"), make, "n_tokens bigint, token_ids array<int>, part int",
                        keep=["doc_id"])
    encoded.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "n_tokens") \
        .write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with start, the ids of all documents before each one.

    Only per-file sums meet in one task; positions inside a file are summed file by file.
    """
    rows = spark.read.schema("doc_id bigint, n_tokens bigint, token_ids array<int>, part int").orc(path)

    def make():
        def work(batch):
            column = batch.column("token_ids")
            flat, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            flat = flat.astype("<u4")
            return {"ids_crc32": [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:])]}

        return work

    checked = per_batch(rows, make, "ids_crc32 bigint", keep=["doc_id", "n_tokens", "part"], name="token_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("_total")).select(
        F.col("part").alias("_part"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return checked.withColumn("_upto", F.sum("n_tokens").over(inside)).join(F.broadcast(bases), F.col("part") == F.col("_part")) \
        .select("doc_id", (F.col("_base") + F.col("_upto") - F.col("n_tokens")).cast("bigint").alias("start"),
                F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids_crc32")
