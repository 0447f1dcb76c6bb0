"""Duplicates inside a batch and against history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.links import normalize_link
from siftwell.functions.text import fingerprint
from siftwell.operators.keyed import first_per_key, top_per_key
from siftwell.operators.rules import valid_posting


def with_keys(df: DataFrame) -> DataFrame:
    """Add the content fingerprint and the canonical link."""
    return df.withColumns({
        "fingerprint": fingerprint("title", "company_name", "description_text"),
        "link": normalize_link("link"),
    })


def unique_in_batch(df: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """Complete postings only, the first of each (user, fingerprint) in landing order."""
    return first_per_key(with_keys(valid_posting(df)), ["user_id", "fingerprint"], order)


def unique_by_key(df: DataFrame, scope: Sequence[str], key: str, order: Sequence[str]) -> DataFrame:
    """The first row per site key within a scrape; rows without a key are dropped."""
    keyed = df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return first_per_key(keyed, [*scope, key], order)


def cap_per_query(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = 25) -> DataFrame:
    """The first ``limit`` results of each search query (the query's own result limit)."""
    return top_per_key(df, keys, order, limit, "_rank").drop("_rank")


def seen_keys(ledger: DataFrame) -> DataFrame:
    return ledger.select("user_id", "fingerprint").filter(F.col("fingerprint").isNotNull())


def new_only(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose (user, fingerprint) is not in the ledger. Run after ``unique_in_batch``: both
    sides then hold each key once, and both exchanges use the same keys."""
    return df.join(seen_keys(ledger), ["user_id", "fingerprint"], "left_anti")


def mark_known(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add ``known``: whether the ledger already has the (user, fingerprint)."""
    seen = seen_keys(ledger).distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, ["user_id", "fingerprint"], "left").withColumn(
        "known", F.coalesce("_seen", F.lit(False))).drop("_seen")
