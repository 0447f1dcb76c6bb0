"""Click attribution and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.constants import CLICK_KEYS
from siftwell.functions.text import truthy
from siftwell.operators.keyed import attach


def trackable(clicks: DataFrame) -> DataFrame:
    """Clicks with source, type and at least one of job and user."""
    return clicks.filter(
        truthy("source").isNotNull() & truthy("type").isNotNull()
        & (truthy("jobId").isNotNull() | truthy("userId").isNotNull()))


def click_key() -> Column:
    return F.concat(F.lower("source"), F.lit("_"), F.lower("type"))


def click_counts(clicks: DataFrame, ledger: DataFrame) -> DataFrame:
    """(user_id, key, clicks): the named user, else the owner of the posting; others are dropped.

    Clicks are counted per (user, posting, key) before the ledger is joined, so a posting that
    draws a third of all clicks reaches the join as one row per key and map task.
    """
    counted = (
        trackable(clicks)
        .withColumn("key", click_key()).filter(F.col("key").isin(CLICK_KEYS))
        .withColumns({"_user": truthy("userId"), "_job": F.when(truthy("userId").isNull(), F.col("jobId"))})
        .groupBy("_user", "_job", "key").agg(F.count(F.lit(1)).alias("n"))
    )
    direct = counted.filter(F.col("_user").isNotNull()).select(F.col("_user").alias("user_id"), "key", "n")
    owners = ledger.select(F.col("id").alias("_job"), "user_id")
    owned = counted.filter(F.col("_user").isNull()).select("_job", "key", "n")
    owned = attach(owned, owners, "_job").select("user_id", "key", "n")
    return direct.unionByName(owned).groupBy("user_id", "key").agg(F.sum("n").alias("clicks"))


def click_counters(counts: DataFrame) -> DataFrame:
    """One row per user with the four counters."""
    return counts.groupBy("user_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("key") == k, F.col("clicks"))), F.lit(0)).alias(f"{k}_clicks")
        for k in CLICK_KEYS])


def add_clicks_to_users(users: DataFrame, counters: DataFrame) -> DataFrame:
    names = [f"{k}_clicks" for k in CLICK_KEYS]
    new = counters.select(F.col("user_id").alias("id"), *[F.col(n).alias(f"_{n}") for n in names])
    joined = users.join(new, "id", "left")
    for n in names:
        joined = joined.withColumn(n, (F.col(n) + F.coalesce(f"_{n}", F.lit(0))).cast("int")).drop(f"_{n}")
    return joined
