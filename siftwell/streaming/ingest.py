"""Continuous form of the batch run: landed files through the cascade into the ledger."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.constants import RETENTION_DAYS
from siftwell.operators.inference import ModelFn
from siftwell.operators.ledger import purge
from siftwell.plans.batch_run import run_batch
from siftwell.plans.cascade import failed_runs
from siftwell.plans.delivery import deliveries, keyed_ledger
from siftwell.schemas import LEDGER
from siftwell.sources import folders

STORED_LEDGER = T.StructType(LEDGER.fields + [T.StructField("day", T.DateType()), T.StructField("batch_id", T.LongType())])


def stored_ledger(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """Ledger rows, kept in folders by day of creation and micro-batch; optionally only those of earlier
    batches (the condition prunes folders)."""
    rows = spark.read.schema(STORED_LEDGER).parquet(path)
    return rows if before_batch is None else rows.filter(F.col("batch_id") < before_batch)


def append_ledger(rows: DataFrame, path: str, batch_id: int) -> None:
    """Put ledger ``rows`` into the folders of their days; those a micro-batch of this number left are replaced."""
    columns = [f.name for f in LEDGER.fields]
    rows.select(*columns, F.to_date("created_at").alias("day"), F.lit(batch_id).cast("bigint").alias("batch_id")) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path)


def create_ledger(spark: SparkSession, path: str) -> None:
    """Make an empty ledger folder, or leave an existing one as it is."""
    spark.createDataFrame([], STORED_LEDGER).write.mode("append").partitionBy("day", "batch_id").parquet(path)


def drop_expired(spark: SparkSession, path: str, now: Column, days: int = RETENTION_DAYS) -> list[str]:
    """Remove the day folders whose rows are all past the retention, and with them their files. The day that
    the limit falls into stays, as do rows without a creation time; ``purge`` leaves its old rows unread."""
    limit = spark.range(1).select(F.to_date(now - F.expr(f"INTERVAL {int(days)} DAYS"))).head()[0]
    return folders.drop_days(spark, path, str(limit))


def utc_now() -> Column:
    return F.lit(datetime.now(timezone.utc))


def batch_writer(users: Callable[[], DataFrame], ledger_path: str, runs_path: str, fn: ModelFn,
                 now: Callable[[], Column] = utc_now, tables: str | None = None, app_url: str = "", **options):
    """The ``foreachBatch`` function.

    ``tables`` names the folder of descriptions, digest, post messages and user counters, each kept by
    micro-batch; without it only ledger and audit are written. Ledger rows past their retention count as
    purged; once a micro-batch is written, the day folders that hold nothing else are removed. Rows of the
    batch without an ``ord`` only say that their user had a file; such users get an audit row as well.

    Each micro-batch overwrites its own folders and sees only the ledger of earlier batches, so a
    batch repeated after a failure gives the same tables. A failing batch leaves FAILED audit rows
    for its users and raises, so its files are not counted as read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        at = now()
        runs = f"{runs_path}/batch_id={batch_id}"
        try:
            ledger, _ = purge(stored_ledger(batch.sparkSession, ledger_path, batch_id), at)
            owners = users()
            result = run_batch(batch.filter(F.col("ord").isNotNull()), owners, ledger, fn, at, present=batch.select("user_id"), **options)
            inserted = result.inserted
            if tables:
                inserted = keyed_ledger(result)
                for name, rows in deliveries(result, owners, app_url).items():
                    rows.write.mode("overwrite").parquet(f"{tables}/{name}/batch_id={batch_id}")
            append_ledger(inserted, ledger_path, batch_id)
            result.runs.write.mode("overwrite").parquet(f"{runs}/outcome=done")
            drop_expired(batch.sparkSession, ledger_path, at)
        except Exception as error:
            failed_runs(batch.select("user_id").distinct(), str(error), at).write.mode(
                "overwrite").parquet(f"{runs}/outcome=failed")
            raise

    return write


def start_ingest(stream: DataFrame, users: Callable[[], DataFrame], ledger_path: str, runs_path: str,
                 checkpoint: str, fn: ModelFn, once: bool = True, **options):
    """Start the ingest query; ``once`` works off what has landed and stops (the scheduled form)."""
    create_ledger(stream.sparkSession, ledger_path)
    writer = stream.writeStream.foreachBatch(
        batch_writer(users, ledger_path, runs_path, fn, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
