"""Pages of a user's postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.keyed import attach, top_per_key

PROFILE_COLUMNS = [
    "id", "name", "email", "experience_years", "target_locations", "employment_type",
    "primary_domain", "candidate_summary", "known_skills", "suggested_job_titles", "chat_id",
]


def _order() -> list[Column]:
    return [F.col("ai_score").desc_nulls_first(), F.col("created_at"), F.col("id")]


def min_score(df: DataFrame, score: float) -> DataFrame:
    """Rows with at least this score; 0 or less keeps all rows, also unscored ones."""
    return df.filter(F.col("ai_score") >= score) if score > 0 else df


def date_range(df: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Created from ``since`` (a time) to the end of the day ``until``."""
    if since is not None:
        df = df.filter(F.col("created_at") >= since)
    if until is not None:
        df = df.filter(F.col("created_at") < F.date_add(until, 1).cast("timestamp"))
    return df


def select_postings(ledger: DataFrame, score: float = 6, since: Column | None = None,
                    until: Column | None = None) -> DataFrame:
    return date_range(min_score(ledger, score), since, until)


def user_page(ledger: DataFrame, user_id, page: int = 1, limit: int = 20, **where) -> DataFrame:
    """One page of one user, best first. Planned as a top-n, not as a full sort."""
    page, limit = max(1, page or 1), max(1, limit or 20)
    rows = select_postings(ledger.filter(F.col("user_id") == user_id), **where)
    return rows.orderBy(*_order()).offset((page - 1) * limit).limit(limit)


def totals(ledger: DataFrame, limit: int = 20, **where) -> DataFrame:
    """Matching rows and pages per user."""
    limit = max(1, limit or 20)
    return select_postings(ledger, **where).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / limit).cast("bigint"))


def all_pages(ledger: DataFrame, users: DataFrame, page: int = 1, limit: int = 20, **where) -> DataFrame:
    """The same page for every user at once, with totals and the user's profile.

    Rows beyond the page are cut before the exchange, so each task sends at most page * limit rows
    per user.
    """
    page, limit = max(1, page or 1), max(1, limit or 20)
    rows = top_per_key(
        select_postings(ledger, **where), ["user_id"], _order(), page * limit, "position")
    rows = rows.filter(F.col("position") > (page - 1) * limit)
    profile = users.select(F.col("id").alias("user_id"), *[
        F.col(c).alias(f"user_{c}") for c in PROFILE_COLUMNS if c != "id" and c in users.columns])
    rows = rows.join(totals(ledger, limit, **where), "user_id")
    return attach(rows, profile, "user_id", how="left")
