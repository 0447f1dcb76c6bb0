"""Log batches and their digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import col, truthy
from siftwell.schemas import LOG_BATCH

SEPARATOR = "\n---\n"


def read_log_batches(spark: SparkSession, path: str) -> DataFrame:
    """Delivered log batches, one JSON object per line; .gz files are unpacked by the reader."""
    return spark.read.schema(LOG_BATCH).json(path)


def log_body(message) -> Column:
    """The ``message`` field when the line is JSON and has a non-empty one, else the line itself."""
    return F.coalesce(truthy(F.get_json_object(col(message), "$.message")), col(message))


def iso_millis(epoch_ms) -> Column:
    return F.date_format(F.timestamp_millis(col(epoch_ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def log_digest(batches: DataFrame) -> DataFrame:
    """Add ``subject`` and ``digest``: all events of a delivered batch in one message.

    A delivery is already one row, so the digest is a projection and needs no grouping.
    """
    lines = F.transform("logEvents", lambda e: F.concat(
        F.lit("["), F.col("logGroup"), F.lit("]\n"), iso_millis(e["timestamp"]), F.lit("\n"),
        log_body(e["message"])))
    return batches.withColumns({
        "subject": F.concat(F.lit("[ERROR] "), F.col("logGroup")),
        "digest": F.array_join(lines, SEPARATOR),
    })


def errors_only(logs: DataFrame, level: str = "level") -> DataFrame:
    return logs.filter(F.col(level) == "ERROR")
