"""Running click counters and daily activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.constants import CLICK_KEYS
from siftwell.functions.text import truthy
from siftwell.operators.clicks import click_key, trackable
from siftwell.operators.keyed import attach

# Local days start at 18:30 UTC of the day before.
LOCAL_DAY_START = "18 hours 30 minutes"


def running_clicks(clicks: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(user_id, key, clicks) over a click stream; use update or complete mode.

    With a ledger, clicks without a user are given to the posting's owner (stream-static join).
    """
    rows = trackable(clicks).withColumn("key", click_key()).filter(F.col("key").isin(CLICK_KEYS))
    user = truthy("userId")
    if ledger is not None:
        owners = ledger.select(F.col("id").alias("jobId"), F.col("user_id").alias("_owner"))
        rows = attach(rows, owners, "jobId", how="left")
        user = F.coalesce(user, F.col("_owner"))
    return rows.withColumn("user_id", user).filter(F.col("user_id").isNotNull()).groupBy(
        "user_id", "key").agg(F.count(F.lit(1)).alias("clicks"))


def daily_activity(runs: DataFrame, keys: list[str] | None = None, lateness: str = "1 day") -> DataFrame:
    """Runs and cost per local day. Complete or update mode also shows the still open day."""
    keys = keys or []
    rows = runs.withWatermark("run_at", lateness).groupBy(
        F.window("run_at", "1 day", startTime=LOCAL_DAY_START).alias("w"), *keys)
    return rows.agg(
        F.count(F.lit(1)).alias("runs_count"),
        F.sum(F.col("actual_cost_usd").cast("decimal(28,8)")).cast("double").alias("total_cost_usd"),
    ).select(
        F.date_format(F.from_utc_timestamp("w.start", "Asia/Kolkata"), "yyyy-MM-dd").alias("day"), *keys,
        "runs_count", "total_cost_usd")
