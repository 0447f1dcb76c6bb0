"""Reports over users, runs, scored postings and clicks."""

from pyspark.sql import functions as F

from siftwell.constants import CLICK_KEYS
from siftwell.operators.clicks import (
    add_clicks_to_users, click_counters as pivot_clicks, click_counts, trackable,
)
from siftwell.plans import dashboard, reports
from siftwell.sources.logs import log_body, log_digest
from siftwell.workload import query
from siftwell.workload import inputs as I

CENTS = lambda e: f"CAST(coalesce(sum(CAST({e} AS DECIMAL(28,8))), 0) AS DOUBLE)"
MRR = f"(SELECT {CENTS('subscription_amount')} FROM users WHERE tier = 'premium')"


@query(I.with_(I.USERS_SQL) + """
SELECT count(*) AS total_users, count(*) FILTER (WHERE is_active) AS active_users,
  count(*) FILTER (WHERE tier = 'premium') AS premium_users, count(*) FILTER (WHERE tier = 'free') AS free_users FROM users""")
def user_counts(spark, sf):
    return reports.user_counts(I.users(spark, sf))


@query(I.with_(I.USERS_SQL) + f" SELECT {MRR} AS mrr")
def mrr(spark, sf):
    return reports.monthly_revenue(I.users(spark, sf))


@query(I.with_(I.USERS_SQL, I.RUNS_SQL) + f"""
SELECT *, mrr - total_cost_usd AS total_profit_usd FROM (
  SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'SUCCESS') AS successful_runs,
    {CENTS('actual_cost_usd')} AS total_cost_usd, {MRR} AS mrr FROM runs)""")
def run_totals(spark, sf):
    return reports.run_totals(I.runs(spark, sf), I.users(spark, sf))


@query(I.with_(I.USERS_SQL, I.RUNS_SQL) + f"""
SELECT *, subscription_revenue - actual_cost_usd AS net_profit_usd FROM (
  SELECT strftime(run_at, '%Y-%m') AS month, count(*) AS runs_count, {CENTS('actual_cost_usd')} AS actual_cost_usd,
    {MRR} AS subscription_revenue FROM runs GROUP BY 1)""")
def monthly_cost(spark, sf):
    return reports.monthly_breakdown(I.runs(spark, sf), I.users(spark, sf))


DAILY_SQL = f"""SELECT strftime(run_at + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, count(*) AS runs_count,
  {CENTS('actual_cost_usd')} AS total_cost_usd, coalesce(min(nullif(actual_cost_usd, 0)), 0) AS min_cost_usd,
  coalesce(max(actual_cost_usd), 0) AS max_cost_usd FROM runs"""


@query(I.with_(I.RUNS_SQL) + DAILY_SQL + " GROUP BY 1")
def daily_cost_local(spark, sf):
    return reports.daily_breakdown(I.runs(spark, sf))


@query(I.with_(I.RUNS_SQL) + DAILY_SQL + " WHERE run_at >= TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 3 DAY GROUP BY 1")
def daily_cost_recent(spark, sf):
    return reports.daily_breakdown(I.runs(spark, sf), F.lit("2024-01-28").cast("date"), 3)


@query("""SELECT coalesce(nullif(source, 'src3'), 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1""")
def by_source(spark, sf):
    rows = I.table(spark, sf, "documents").select(F.nullif("source", F.lit("src3")).alias("source"))
    return reports.by_source(rows)


@query(I.with_(I.RUNS_SQL) + """
SELECT user_id, count(*) FILTER (WHERE status = 'SUCCESS') AS runs,
  strftime(max(run_at) FILTER (WHERE status = 'SUCCESS'), '%Y-%m-%d %H:%M:%S') AS last_run FROM runs GROUP BY user_id""")
def user_run_counters(spark, sf):
    from siftwell.operators.users import run_counters

    return run_counters(I.runs(spark, sf)).withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss"))


CLICK_SUM_SQL = """owned AS (
  SELECT coalesce(c.user_id, o.user_id) AS user_id, key FROM clicks c
  LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id FROM orders) o ON o.id = c.job_id
  WHERE key IS NOT NULL)"""


@query(I.with_(I.CLICKS_SQL, CLICK_SUM_SQL) + """
SELECT user_id, count(*) FILTER (WHERE key = 'telegram_apply') AS telegram_apply_clicks,
  count(*) FILTER (WHERE key = 'telegram_resume') AS telegram_resume_clicks,
  count(*) FILTER (WHERE key = 'dashboard_apply') AS dashboard_apply_clicks,
  count(*) FILTER (WHERE key = 'dashboard_resume') AS dashboard_resume_clicks
FROM owned WHERE user_id IS NOT NULL GROUP BY user_id""")
def click_counters(spark, sf):
    return pivot_clicks(click_counts(I.clicks(spark, sf), I.scored(spark, sf)))


@query(I.with_(I.CLICKS_SQL) + """
SELECT count(*) AS kept FROM events WHERE event_id % 2 = 0 OR event_type <> 'error'""")
def trackable_clicks(spark, sf):
    """Clicks that name a source, a type and a posting or user; posting-only errors lose their type."""
    rows = I.clicks(spark, sf).withColumn("type", F.when(
        (F.col("source") != "mail") | F.col("userId").isNotNull(), F.col("type")))
    return trackable(rows).agg(F.count(F.lit(1)).alias("kept"))


@query(I.with_(I.USERS_SQL, I.CLICKS_SQL, CLICK_SUM_SQL) + """
SELECT id, CAST(count(*) FILTER (WHERE key = 'telegram_apply') AS INTEGER) AS telegram_apply_clicks,
  CAST(count(*) FILTER (WHERE key = 'telegram_resume') + 1 AS INTEGER) AS telegram_resume_clicks,
  CAST(count(*) FILTER (WHERE key = 'dashboard_apply') AS INTEGER) AS dashboard_apply_clicks,
  CAST(count(*) FILTER (WHERE key = 'dashboard_resume') AS INTEGER) AS dashboard_resume_clicks
FROM users LEFT JOIN owned ON owned.user_id = id GROUP BY id""")
def users_with_clicks(spark, sf):
    """Lifetime counters after adding the counted clicks."""
    base = I.users(spark, sf).select("id").withColumns({
        f"{k}_clicks": F.lit(1 if k == "telegram_resume" else 0) for k in CLICK_KEYS})
    return add_clicks_to_users(base, pivot_clicks(click_counts(I.clicks(spark, sf), I.scored(spark, sf))))


@query(I.with_(I.SCORED_SQL) + """
SELECT user_id, id, ai_score, position, total, CAST(ceil(total / 3.0) AS BIGINT) AS total_pages, c_name AS user_name FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ai_score DESC NULLS FIRST, created_at, id) AS position,
    count(*) OVER (PARTITION BY user_id) AS total FROM scored
  WHERE ai_score >= 6 AND created_at >= TIMESTAMP '1996-01-01 00:00:00' AND created_at < TIMESTAMP '2001-01-01 00:00:00')
JOIN customer ON CAST(c_custkey AS VARCHAR) = user_id WHERE position BETWEEN 4 AND 6""")
def dashboard_page(spark, sf):
    """Page two, three rows a page, for every user."""
    day = lambda d: F.lit(d).cast("date")
    rows = dashboard.all_pages(
        I.scored(spark, sf), I.users(spark, sf), page=2, limit=3, score=6,
        since=day("1996-01-01").cast("timestamp"), until=day("2000-12-31"))
    return rows.select("user_id", "id", "ai_score", F.col("position").cast("bigint").alias("position"), "total",
                       "total_pages", "user_name")


@query(I.with_(I.SCORED_SQL) + """
SELECT id, ai_score FROM scored WHERE user_id = (SELECT max(user_id) FROM scored)
ORDER BY ai_score DESC NULLS FIRST, created_at, id LIMIT 20""")
def user_first_page(spark, sf):
    """First page of one user with unscored rows; the page size is the feature."""
    rows = I.scored(spark, sf)
    last = rows.agg(F.max("user_id").alias("u")).scalar()
    return dashboard.user_page(rows, last, page=1, limit=20, score=0).select("id", "ai_score")


@query(I.with_(I.SCORED_SQL) + """
SELECT user_id, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM scored
WHERE ai_score >= 6 GROUP BY user_id""")
def page_totals(spark, sf):
    return dashboard.totals(I.scored(spark, sf))


# --- costs, calls, logs -----------------------------------------------------------------------------

def _usage(spark, sf):
    e = I.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id", "user_id", "event_type", (k * 1000).alias("cache_hit_tokens"),
        F.floor(F.col("value") * 100).alias("cache_miss_tokens"), (k * 7).alias("completion_tokens"),
        k.alias("scraped_jobs_count"))


USAGE_SQL = """usage AS (
  SELECT event_id, user_id, event_type, CAST(props->>'$.k' AS BIGINT) AS k, CAST(props->>'$.k' AS BIGINT) * 1000 AS hit,
    CAST(floor(value * 100) AS BIGINT) AS miss, CAST(props->>'$.k' AS BIGINT) * 7 AS done FROM events)"""


@query(I.with_(USAGE_SQL) + """
SELECT event_id, CAST(m AS DOUBLE) AS model_cost_usd, CAST(s AS DOUBLE) AS scrape_cost_usd, CAST(m + s AS DOUBLE) AS total_cost_usd FROM (
  SELECT event_id, round(CAST(hit * 0.014 + miss * 0.14 + done * 0.28 AS DECIMAL(20,3)) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS m,
    round(CAST(k * 0.001 AS DECIMAL(20,3)), 6) AS s FROM usage)""")
def token_cost(spark, sf):
    return reports.run_cost(_usage(spark, sf)).select(
        "event_id", "model_cost_usd", "scrape_cost_usd", "total_cost_usd")


@query(I.with_(USAGE_SQL) + """
SELECT user_id, round(sum(hit) * 100.0::DOUBLE / (sum(hit) + sum(miss)), 6) AS cache_hit_pct FROM usage GROUP BY user_id""")
def cache_rate(spark, sf):
    out = reports.cache_hit_rate(_usage(spark, sf), ["user_id"])
    return out.withColumn("cache_hit_pct", F.round("cache_hit_pct", 6))


def _calls(spark, sf):
    return I.table(spark, sf, "events").select(
        "user_id", (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration_ms"),
        F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("error"))


@query("""
SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error') AS successful,
  count(*) FILTER (WHERE event_type = 'error') AS failed,
  round(count(*) FILTER (WHERE event_type <> 'error') * 100.0::DOUBLE / count(*), 1) AS success_pct,
  coalesce(CAST(floor(CAST(sum(CAST(value AS DECIMAL(28,8))) FILTER (WHERE event_type <> 'error') AS DOUBLE)
    / count(*) FILTER (WHERE event_type <> 'error') + 0.5) AS BIGINT), 0) AS avg_ms
FROM events GROUP BY user_id""")
def call_stats(spark, sf):
    return reports.call_stats(_calls(spark, sf), ["user_id"])


@query("""
SELECT user_id, CASE WHEN event_id % 3 <> 0 THEN props ELSE 'Unknown error' END AS error, count(*) AS n
FROM events WHERE event_type = 'error' GROUP BY ALL""")
def error_histogram(spark, sf):
    return reports.error_histogram(_calls(spark, sf), ["user_id"])


def _log_batches(spark, sf):
    """Deliveries of error lines: at most 100 consecutive events each."""
    e = I.table(spark, sf, "events").filter(F.col("event_type") == "error")
    message = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(
        F.concat(F.lit('{"message": "user '), F.col("user_id").cast("string"), F.lit('"}')))
    event = F.struct(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), message.alias("message"))
    batches = e.groupBy(F.floor(F.col("event_id") / 100).alias("delivery")).agg(
        F.array_sort(F.collect_list(event)).alias("logEvents"))
    return batches.withColumn("logGroup", F.concat(F.lit("app"), (F.col("delivery") % 3).cast("string")))


@query("""
SELECT event_id // 100 AS delivery, '[ERROR] app' || (event_id // 100) % 3 AS subject,
  string_agg('[app' || (event_id // 100) % 3 || ']' || chr(10) || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' || chr(10)
    || CASE WHEN event_id % 2 = 0 THEN props ELSE 'user ' || user_id END, chr(10) || '---' || chr(10) ORDER BY event_id) AS digest
FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def error_digest(spark, sf):
    return log_digest(_log_batches(spark, sf)).select("delivery", "subject", "digest")


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE 'user ' || user_id END AS body FROM events WHERE event_type = 'error'""")
def log_bodies(spark, sf):
    from siftwell.sources.logs import errors_only

    message = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(
        F.concat(F.lit('{"message": "user '), F.col("user_id").cast("string"), F.lit('"}')))
    rows = I.table(spark, sf, "events").withColumn("level", F.upper("event_type"))
    return errors_only(rows).select("event_id", log_body(message).alias("body"))


@query("""
WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS req, list_slice(string_split(p_name, ' '), 1, p_size % 3) AS have FROM part),
x AS (SELECT unnest(req) AS skill, have FROM s)
SELECT skill, count(*) AS asked, count(*) FILTER (WHERE list_contains(have, skill)) AS matched FROM x GROUP BY skill""")
def skill_demand(spark, sf):
    words = F.split("p_name", " ")
    rows = I.table(spark, sf, "part").select(
        words.alias("required_skills"),
        F.slice(words, 1, (F.col("p_size") % 3).cast("int")).alias("candidate_matched_required_skills"))
    return reports.skill_demand(rows)


@query(I.with_(I.SCORED_SQL) + """
SELECT title, count(ai_score) AS scored, count(*) FILTER (WHERE ai_score >= 7) AS matched,
  round(count(*) FILTER (WHERE ai_score >= 7) * 100.0::DOUBLE / count(ai_score), 1) AS match_pct FROM scored GROUP BY title""")
def match_rate(spark, sf):
    return reports.match_rate(I.scored(spark, sf), ["title"])
