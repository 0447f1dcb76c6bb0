"""What a run delivers besides ledger and audit: descriptions, digest, post messages, user counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.fit import strings
from siftwell.functions.render import match_card
from siftwell.functions.text import finite, truthy
from siftwell.operators.ledger import apply_mapping
from siftwell.operators.queue import build_post_messages
from siftwell.operators.users import run_counters
from siftwell.plans.batch_run import BatchResult
from siftwell.plans.digest import rank_digest


def matched_rows(evaluated: DataFrame) -> DataFrame:
    """Matched postings with the columns cards and post messages are made of."""
    f = F.col("facts")
    return evaluated.filter(F.col("status") == "matched").select(
        "user_id", "ord", F.col("ledger_id").alias("id"), "link", "title", "company_name", "location", "source",
        "posted_at", "salary", "employment_type", "seniority_level",
        F.col("score").alias("ai_score"), F.col("reason").alias("ai_reason"), f["job_location"].alias("ai_job_location"),
        finite(f["min_required_yoe"]).alias("min_required_yoe"), finite(f["max_required_yoe"]).alias("max_required_yoe"),
        strings(f["required_skills"]).alias("required_skills"), strings(f["preferred_skills"]).alias("preferred_skills"),
        F.coalesce(truthy(f["direct_apply"]), truthy("apply_url")).alias("direct_apply"),
        "matched_skills", "missing_skills")


def order_bucket(rows: DataFrame, order: str = "ord"):
    """A part of the landing order to rank in: the file of a (file, position), else blocks of numbers."""
    kind = rows.schema[order].dataType
    return F.col(order)[kind.names[0]] if hasattr(kind, "names") else F.floor(F.col(order) / 65536)


def keyed_ledger(result: BatchResult) -> DataFrame:
    """The rows to append, with the keys of their stored descriptions. Only keys are moved for it."""
    keys = result.descriptions.select(F.col("ledger_id").alias("id"), F.col("key").alias("new_value")).distinct()
    return apply_mapping(result.inserted, keys, "id", "description_key")


def deliveries(result: BatchResult, users: DataFrame, app_url: str) -> dict[str, DataFrame]:
    """The tables of one run by name. Post messages need ``credentials`` in ``users``."""
    matched = matched_rows(result.evaluated)
    digest = rank_digest(matched, bucket=[order_bucket(matched)]).withColumn("card", match_card("rank", app_url))
    tables = {
        "descriptions": result.descriptions,
        "digest": digest.select("user_id", "rank", F.col("id").alias("ledger_id"), "card"),
        "user_counters": run_counters(result.runs),
    }
    if "credentials" in users.columns:
        tables["posts"] = build_post_messages(matched, users)
    return tables
