"""How the test tables play the roles of postings, users, ledger, runs and clicks.

Each role exists twice, as a DataFrame and as a SQL common table expression; both derive the same
rows from whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources.tables import load_table, widen

NOW = "2024-02-01 00:00:00"
RETENTION_NOW = "2001-08-01 00:00:00"
BLOCKLIST = ["es corp"]


def now(text: str = NOW):
    return F.lit(text).cast("timestamp")


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    scan = load_table(spark, sf, name)
    return widen(scan, TEXT_TABLES[name]) if name in TEXT_TABLES else scan


# --- postings: documents with a role title, an experience sentence and a date --------------

def yoe_sentence(n):
    """Five shapes of an experience sentence, chosen by a number."""
    a, b = (n % 12).cast("string"), (n % 12 + n % 4).cast("string")
    return (
        F.when(n % 5 == 0, F.concat(F.lit("Requires "), a, F.lit(" years of work.")))
        .when(n % 5 == 1, F.concat(F.lit("Requires "), a, F.lit("+ years of work.")))
        .when(n % 5 == 2, F.concat(F.lit("Requires "), a, F.lit("-"), b, F.lit(" years of work.")))
        .when(n % 5 == 3, F.concat(F.lit("Requires "), a, F.lit(" – "), b, F.lit(" year's work.")))
        .otherwise(F.concat(F.lit("For people with up to "), b, F.lit(" years of work.")))
    )


def yoe_sentence_sql(n: str) -> str:
    a, b = f"CAST({n} % 12 AS VARCHAR)", f"CAST({n} % 12 + {n} % 4 AS VARCHAR)"
    return f"""CASE {n} % 5
        WHEN 0 THEN 'Requires ' || {a} || ' years of work.'
        WHEN 1 THEN 'Requires ' || {a} || '+ years of work.'
        WHEN 2 THEN 'Requires ' || {a} || '-' || {b} || ' years of work.'
        WHEN 3 THEN 'Requires ' || {a} || ' – ' || {b} || ' year''s work.'
        ELSE 'For people with up to ' || {b} || ' years of work.' END"""


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return postings_from(table(spark, sf, "documents"))


def postings_from(documents: DataFrame) -> DataFrame:
    n = F.col("n_chars")
    first_line = F.get(F.split("text", "\n"), F.lit(0))
    role = (F.when(n % 7 == 0, "Senior Manager").when(n % 7 == 1, "Junior Developer")
            .when(n % 7 == 2, "Tech Lead").when(n % 7 == 3, "Intern Analyst").otherwise("Engineer"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 40).cast("int")), "yyyy-MM-dd")
    none = F.lit(None).cast("string")
    return documents.select(
        (n % 100).cast("string").alias("user_id"), F.col("doc_id").alias("ord"),
        F.concat(F.lit("https://Jobs.example.com/view/"), F.col("doc_id").cast("string"), F.lit("?ref=x")).alias("link"),
        F.concat(role, F.lit(" "), first_line).alias("title"),
        F.concat("lang", F.lit(" Corp")).alias("company_name"),
        F.concat("text", F.lit(" "), yoe_sentence(n)).alias("description_text"),
        F.col("lang").alias("seniority_level"),
        F.when(n % 11 == 0, none).when(n % 13 == 0, "2 days ago").otherwise(day).alias("posted_at"),
        F.lit("Pune").alias("location"), none.alias("salary"), none.alias("applicants_count"),
        none.alias("apply_url"), F.lit("Full-time").alias("employment_type"),
        none.alias("job_function"), none.alias("industries"),
        F.array().cast("array<string>").alias("benefits"), F.col("source").alias("source"),
    )


POSTINGS_SQL = f"""postings AS (
  SELECT CAST(n_chars % 100 AS VARCHAR) AS user_id, doc_id AS ord,
    'https://Jobs.example.com/view/' || doc_id || '?ref=x' AS link,
    CASE n_chars % 7 WHEN 0 THEN 'Senior Manager' WHEN 1 THEN 'Junior Developer' WHEN 2 THEN 'Tech Lead'
      WHEN 3 THEN 'Intern Analyst' ELSE 'Engineer' END || ' ' || split_part(text, chr(10), 1) AS title,
    lang || ' Corp' AS company_name,
    text || ' ' || {yoe_sentence_sql('n_chars')} AS description_text,
    lang AS seniority_level,
    CASE WHEN n_chars % 11 = 0 THEN NULL WHEN n_chars % 13 = 0 THEN '2 days ago'
      ELSE strftime(DATE '2024-01-01' + CAST(n_chars % 40 AS INTEGER), '%Y-%m-%d') END AS posted_at,
    source
  FROM documents)"""


# --- users: customers ------------------------------------------------------------------------

def users(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    excludes = (F.when(k % 3 == 0, words("tech lead", "Analyst")).when(k % 3 == 1, words(" Developer "))
                .otherwise(words()))
    return table(spark, sf, "customer").select(
        k.cast("string").alias("id"), F.concat("c_name", F.lit("@Example.com")).alias("email"),
        F.col("c_name").alias("name"),
        F.when(k % 5 != 0, F.concat(F.lit("chat"), k.cast("string"))).alias("chat_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "premium").otherwise("free").alias("tier"),
        F.col("c_acctbal").alias("subscription_amount"),
        (k % 10 + 0.5).cast("double").alias("experience_years"),
        excludes.cast("array<string>").alias("exclude_title_keywords"),
        (k % 7 != 0).alias("is_active"), F.col("c_mktsegment").alias("primary_domain"),
        F.lit(None).cast("string").alias("target_locations"),
        F.lit("Full-time").alias("employment_type"), F.lit("").alias("candidate_summary"),
        F.array(F.lit("Python"), F.lit("AWS")).alias("known_skills"),
        F.array().cast("array<string>").alias("education"),
        F.array().cast("array<struct<project_title:string,project_description:string>>").alias("projects"),
        F.array().cast("array<string>").alias("certifications"),
        F.array().cast("array<string>").alias("key_highlights"),
        F.array(F.col("c_mktsegment")).alias("suggested_job_titles"),
        (k % 50).cast("int").alias("total_runs_count"),
    )


USERS_SQL = """users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || '@Example.com' AS email, c_name AS name,
    CASE WHEN c_custkey % 5 <> 0 THEN 'chat' || c_custkey END AS chat_id,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'premium' ELSE 'free' END AS tier,
    c_acctbal AS subscription_amount, c_custkey % 10 + 0.5 AS experience_years,
    CASE c_custkey % 3 WHEN 0 THEN ['tech lead', 'analyst'] WHEN 1 THEN ['developer'] ELSE [] END AS excludes,
    c_custkey % 7 <> 0 AS is_active, c_custkey % 50 AS total_runs_count, c_custkey
  FROM customer)"""


# --- keys and history ----------------------------------------------------------------------------

def norm_sql(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '\\s+', ' ', 'g'))"


FINGERPRINT_SQL = (
    f"sha256({norm_sql('title')} || '|' || {norm_sql('company_name')} || '|' || {norm_sql('description_text')})"
)
TRIMMED_SQL = "trim(description_text, ' ' || chr(9) || chr(10) || chr(13))"


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows of the postings whose document has a good label."""
    from siftwell.operators.dedup import with_keys
    from siftwell.operators.ledger import ledger_id

    good = table(spark, sf, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("ord"))
    rows = with_keys(postings(spark, sf).join(good, "ord", "left_semi"))
    return rows.select("user_id", F.col("link").alias("job_link"), "fingerprint").withColumn("id", ledger_id())


HISTORY_SQL = f"""history AS (
  SELECT user_id, 'https://www.linkedin.com/jobs/view/' || ord AS job_link, {FINGERPRINT_SQL} AS fingerprint,
    sha256(user_id || '|' || {FINGERPRINT_SQL}) AS id
  FROM postings WHERE ord IN (SELECT doc_id FROM labels WHERE quality = 1))"""


# --- runs and clicks: events -----------------------------------------------------------------------

def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("run_at"),
        F.when(F.col("event_type") == "purchase", "SUCCESS").otherwise("FAILED").alias("status"),
        F.col("value").alias("actual_cost_usd"), "event_id", "event_type")


RUNS_SQL = """runs AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, ts AS run_at,
    CASE WHEN event_type = 'purchase' THEN 'SUCCESS' ELSE 'FAILED' END AS status,
    value AS actual_cost_usd, event_id, event_type
  FROM events)"""


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the clicks name the user, half only the posting (an order)."""
    return clicks_from(table(spark, sf, "events"))


def clicks_from(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    by_user = F.col("event_id") % 2 == 0
    return events.select(
        F.when(~by_user, F.col("event_id").cast("string")).alias("jobId"),
        F.when(by_user, F.col("user_id").cast("string")).alias("userId"),
        F.when(kind.isin("click", "view"), "Telegram").when(kind.isin("purchase", "signup"), "dashboard")
        .otherwise("mail").alias("source"),
        F.when(kind.isin("click", "purchase"), "apply").otherwise("Resume").alias("type"),
        F.col("ts").cast("timestamp").alias("ts"))


CLICKS_SQL = """clicks AS (
  SELECT CASE WHEN event_id % 2 = 1 THEN CAST(event_id AS VARCHAR) END AS job_id,
    CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
    CASE event_type WHEN 'click' THEN 'telegram_apply' WHEN 'view' THEN 'telegram_resume'
      WHEN 'purchase' THEN 'dashboard_apply' WHEN 'signup' THEN 'dashboard_resume' END AS key
  FROM events)"""


# --- scored postings: orders ---------------------------------------------------------------------------

def scored(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"),
        F.when(k % 11 != 0, (k % 11).cast("int")).alias("ai_score"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), k.alias("ord"),
        F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"))


SCORED_SQL = """scored AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 11 AS INTEGER) END AS ai_score,
    o_orderdate AS created_at, o_orderkey AS ord, o_orderpriority AS title, o_orderstatus AS status
  FROM orders)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)
