"""Landed batches: one JSON envelope per user, site and scrape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.normalize import normalize_jobs
from siftwell.schemas import ENVELOPE

USER_IN_PATH = r"/raw-jobs/(?:user_id=)?([^/]+)/"


def explode_envelopes(files: DataFrame, silent: bool = False) -> DataFrame:
    """One normalised posting per array element, with user, file and position.

    ``ord`` orders a user's postings: file, then place in the file. Files that are not an envelope
    with a ``jobs`` array give no rows, or with ``silent`` one row without an ``ord`` or a posting.
    """
    explode = F.posexplode_outer if silent else F.posexplode
    path = F.col("_metadata.file_path")
    jobs = files.select(
        F.regexp_extract(path, USER_IN_PATH, 1).alias("user_id"), path.alias("file"),
        "platform", "keyword", F.try_to_timestamp("scrapedAt").alias("scraped_at"),
        explode("jobs").alias("pos", "job"),
    )
    keep = ("user_id", "file", "pos", "platform", "keyword", "scraped_at")
    return normalize_jobs(jobs, keep=keep).withColumn("ord", F.when(F.col("pos").isNotNull(), F.struct("file", "pos")))


def read_raw_batches(spark: SparkSession, path: str) -> DataFrame:
    """All landed files of all users. Every file is read, however many there are."""
    files = (
        spark.read.schema(ENVELOPE)
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        .json(path)
    )
    return explode_envelopes(files)


def users_with_files(spark: SparkSession, path: str) -> DataFrame:
    """Users that have at least one landed file (also when no posting can be read from it)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").load(path).select("path")
    )
    return files.select(F.regexp_extract("path", USER_IN_PATH, 1).alias("user_id")).distinct()


def stream_raw_batches(spark: SparkSession, path: str, archive: str | None = None,
                       max_files: int | None = None, delete: bool = False) -> DataFrame:
    """The same files as a stream: each is read once; with ``archive`` or ``delete`` it is then moved there or
    removed, after the micro-batch that read it is committed. Files without a readable posting give one row
    without an ``ord``, so that their users are known to have been there."""
    reader = (
        spark.readStream.schema(ENVELOPE)
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    )
    if delete:
        reader = reader.option("cleanSource", "delete")
    elif archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return explode_envelopes(reader.json(path), silent=True)


JOBS_PER_FILE = 1000  # postings of one landed file, on average


def write_fan_out(postings: DataFrame, members: DataFrame, root: str, scraped_at: Column,
                  jobs_per_file: int = JOBS_PER_FILE) -> None:
    """Deliver each task's postings to every subscriber of the task, as the files ``read_raw_batches`` reads.

    ``postings`` has task_key, platform, keyword, location and a ``job`` struct; ``members`` has task_key and
    user_id. A task's postings are put into envelopes once, of about ``jobs_per_file`` postings each, and
    the envelopes are joined to the subscribers: one file ``<root>/raw-jobs/user_id=<user>/...`` each.
    """
    task = ["task_key", "platform", "keyword", "location"]
    sizes = postings.groupBy("task_key").agg(F.ceil(F.count("*") / jobs_per_file).alias("_parts"))
    envelopes = postings.join(sizes, "task_key").groupBy(*task, F.pmod(F.xxhash64("job"), F.col("_parts")).alias("_part")) \
        .agg(F.collect_list("job").alias("jobs")).select(
            "task_key", "platform", "keyword", "location",
            F.date_format(scraped_at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("scrapedAt"), F.size("jobs").alias("count"), "jobs")
    fan_out(envelopes, members).drop("task_key").write.mode("append").option("maxRecordsPerFile", 1) \
        .partitionBy("user_id").json(f"{root.rstrip('/')}/raw-jobs")


def fan_out(postings: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, posting columns): one copy per subscriber. Tasks without postings or subscribers
    give nothing. Adaptive execution splits the partition of a task with very many subscribers."""
    return members.select("task_key", "user_id").join(postings, "task_key")


def fan_out_counts(postings: DataFrame, members: DataFrame) -> DataFrame:
    """user_id, copies: how many rows ``fan_out`` gives each subscriber. Postings are counted per task before
    they meet subscribers, so no copy is made; subscribers who get none are left out."""
    counts = postings.groupBy("task_key").agg(F.count(F.lit(1)).alias("_n"))
    return fan_out(counts, members).groupBy("user_id").agg(F.sum("_n").alias("copies"))
