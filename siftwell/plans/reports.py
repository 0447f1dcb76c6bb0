"""Reports over users, runs and the ledger.

Money is summed as decimals: the result then does not depend on how rows are split over tasks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.constants import (
    FREE, LOCAL_ZONE, PREMIUM, PRICE_CACHE_HIT, PRICE_CACHE_MISS, PRICE_COMPLETION, PRICE_PER_POSTING,
)
from siftwell.functions.fit import normalize_skill

MONEY = "decimal(28,8)"


def money_sum(c) -> Column:
    """Exact sum of a double column, as a double; 0 when there is nothing to sum."""
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(value.cast(MONEY)).cast("double"), F.lit(0.0))


def user_counts(users: DataFrame) -> DataFrame:
    return users.agg(
        F.count(F.lit(1)).alias("total_users"), F.count_if("is_active").alias("active_users"),
        F.count_if(F.col("tier") == PREMIUM).alias("premium_users"),
        F.count_if(F.col("tier") == FREE).alias("free_users"))


def monthly_revenue(users: DataFrame) -> DataFrame:
    """Recurring revenue: subscription amounts of premium users."""
    return users.agg(
        money_sum(F.when(F.col("tier") == PREMIUM, F.col("subscription_amount"))).alias("mrr"))


def run_totals(runs: DataFrame, users: DataFrame) -> DataFrame:
    """Runs, successes, cost, and revenue minus cost."""
    mrr = monthly_revenue(users).scalar()
    totals = runs.agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("status") == "SUCCESS").alias("successful_runs"),
        money_sum("actual_cost_usd").alias("total_cost_usd"))
    return totals.withColumn("mrr", mrr).withColumn("total_profit_usd", F.col("mrr") - F.col("total_cost_usd"))


def monthly_breakdown(runs: DataFrame, users: DataFrame) -> DataFrame:
    """Per month, newest first: runs, cost, the (constant) revenue and what is left."""
    months = runs.groupBy(F.date_format("run_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("runs_count"), money_sum("actual_cost_usd").alias("actual_cost_usd"))
    return (
        months.withColumn("subscription_revenue", monthly_revenue(users).scalar())
        .withColumn("net_profit_usd", F.col("subscription_revenue") - F.col("actual_cost_usd"))
        .orderBy(F.col("month").desc())
    )


def local_day(ts) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, LOCAL_ZONE), "yyyy-MM-dd")


def daily_breakdown(runs: DataFrame, today: Column | None = None, days: int = 3) -> DataFrame:
    """Per local day, newest first: runs, total, smallest non-zero and largest cost.

    With ``today`` only runs since ``today - days`` (UTC midnight) count, so up to days + 1 local
    days appear.
    """
    if today is not None:
        runs = runs.filter(F.col("run_at") >= F.date_sub(today, days).cast("timestamp"))
    cost = F.col("actual_cost_usd")
    return runs.groupBy(local_day("run_at").alias("day")).agg(
        F.count(F.lit(1)).alias("runs_count"), money_sum("actual_cost_usd").alias("total_cost_usd"),
        F.coalesce(F.min(F.nullif(cost, F.lit(0.0))), F.lit(0.0)).alias("min_cost_usd"),
        F.coalesce(F.max(cost), F.lit(0.0)).alias("max_cost_usd"),
    ).orderBy(F.col("day").desc())


def by_source(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source")


def run_cost(usage: DataFrame) -> DataFrame:
    """Priced cost from token counts and scraped postings, to six digits (exact decimals, ties up)."""
    price = lambda c, p: F.col(c).cast("bigint") * F.lit(Decimal(str(p)))
    model = (price("cache_hit_tokens", PRICE_CACHE_HIT) + price("cache_miss_tokens", PRICE_CACHE_MISS)
             + price("completion_tokens", PRICE_COMPLETION)) * F.lit(Decimal("0.000001"))
    scrape = price("scraped_jobs_count", PRICE_PER_POSTING)
    return usage.withColumns({
        "model_cost_usd": F.round(model, 6).cast("double"),
        "scrape_cost_usd": F.round(scrape, 6).cast("double"),
        "total_cost_usd": F.round(F.round(model, 6) + F.round(scrape, 6), 6).cast("double"),
    })


def cache_hit_rate(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Share of prompt tokens served from cache, in percent; 0 without any."""
    hit, miss = F.sum("cache_hit_tokens"), F.sum("cache_miss_tokens")
    rate = F.try_divide(hit * F.lit(100.0), hit + miss)
    return usage.groupBy(*keys).agg(F.coalesce(rate, F.lit(0.0)).alias("cache_hit_pct"))


def call_stats(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, successes, success rate in percent and mean latency of successes (whole ms)."""
    ok = F.col("success")
    mean = F.avg(F.when(ok, F.col("duration_ms").cast(MONEY))).cast("double")
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.round(F.count_if(ok) * 100.0 / F.count(F.lit(1)), 1).alias("success_pct"),
        F.coalesce(F.floor(mean + 0.5), F.lit(0)).alias("avg_ms"))


def error_histogram(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.filter(~F.col("success")).groupBy(
        *keys, F.coalesce("error", F.lit("Unknown error")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def prefilter_summary(rows: DataFrame) -> DataFrame:
    """Rejected rows of the experience filter, split into under- and overqualified."""
    under = F.col("yoe_min") > F.col("candidate_years")
    rejected = rows.filter(F.col("reason").isNotNull())
    return rejected.agg(
        F.count(F.lit(1)).alias("rejected"), F.count_if(under).alias("underqualified"),
        F.count_if(~F.coalesce(under, F.lit(False))).alias("overqualified"))


def skill_demand(ledger: DataFrame) -> DataFrame:
    """How often each required skill is asked for, and how often the candidate had it."""
    one = ledger.select(
        F.transform("candidate_matched_required_skills", normalize_skill).alias("have"),
        F.explode("required_skills").alias("skill"))
    return one.select(normalize_skill(F.col("skill")).alias("skill"), "have").groupBy("skill").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(F.array_contains("have", F.col("skill"))).alias("matched"))


def match_rate(ledger: DataFrame, keys: list[str], threshold: int = 7) -> DataFrame:
    """Scored postings per key and the share with a matching score, in percent."""
    n, hit = F.count("ai_score"), F.count_if(F.col("ai_score") >= threshold)
    return ledger.groupBy(*keys).agg(
        n.alias("scored"), hit.alias("matched"),
        F.coalesce(F.round(F.try_divide(hit * F.lit(100.0), n), 1), F.lit(0.0)).alias("match_pct"))
