"""Tables and whole-text objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table kept as parquet: ``root/name.parquet`` or ``root/name/``."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def widen(scan: DataFrame, key: str) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores.

    A few large unsplittable files (one row group, gzip, multi-line JSON) would otherwise bind all
    text work to a few tasks. A scan with enough splits is left alone, so big tables never pay for
    this. Only for plain scans: it looks at the number of splits.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= 2 * cores else scan.repartition(2 * cores, key)


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, lower=None, upper=None,
              partitions: int = 1, **options) -> DataFrame:
    """A table of a relational database, read in ``partitions`` ranges of ``column`` in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column:
        reader = reader.options(
            partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of whole text objects; the key is the path below the folder."""
    root = path.rstrip("/") + "/"
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    full = F.col("_metadata.file_path")
    at = F.instr(full, root)
    return files.select(
        F.when(at > 0, F.substr(full, at + len(root))).otherwise(full).alias("key"),
        F.col("value").alias("text"))


def attach_texts(df: DataFrame, texts: DataFrame, key: str, name: str) -> DataFrame:
    """Add the text an object key points to; null when there is no key or no object."""
    named = texts.select(F.col("key").alias(key), F.col("text").alias(name))
    return df.join(named, key, "left")
