"""Ranked digest of matched postings per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.render import match_card, run_summary, upgrade_notice
from siftwell.operators.keyed import rank_per_key


def rank_digest(matched: DataFrame, score: str = "ai_score", order: str = "ord", bucket=None) -> DataFrame:
    """Add ``rank`` 1..n per user, best score first, ties in input order.

    Ranked in buckets (score, then ``bucket`` along the order), so a user with very many matches is
    spread over tasks.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    return rank_per_key(
        matched, ["user_id"], [value.desc(), F.col(order)], [-value, *(bucket or [])], "rank")


def digest_cards(matched: DataFrame, app_url: str, **kw) -> DataFrame:
    return rank_digest(matched, **kw).withColumn("card", match_card("rank", app_url))


def digest_headers(runs: DataFrame, users: DataFrame) -> DataFrame:
    """Header and upgrade note per run of users that have a chat."""
    chats = users.select(F.col("id").alias("user_id"), "chat_id", "tier").filter(
        F.col("chat_id").isNotNull() & (F.col("chat_id") != ""))
    return runs.join(chats, "user_id").select(
        "user_id", "chat_id", "run_at",
        run_summary("run_at", "scraped_jobs_count", "matched_jobs_count").alias("header"),
        upgrade_notice("tier", "matched_jobs_count").alias("upgrade"))
