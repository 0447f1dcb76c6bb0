"""Search planning."""

from pyspark.sql import functions as F

from siftwell.plans import search_tasks as S
from siftwell.session import scratch_path
from siftwell.sources.landing import fan_out_counts, read_raw_batches, write_fan_out
from siftwell.workload import query
from siftwell.workload import inputs as I

CITIES = "Bengaluru|Hyderabad|Mumbai|Delhi|Gurugram|Noida|Pune|Chennai|India"


def _seekers(spark, sf):
    """Users asking for their segment (in two spellings) and their nation, at named or default places."""
    c, k = I.table(spark, sf, "customer"), F.col("c_custkey")
    n = I.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    titles = F.array(
        F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" "))),
        F.concat("n_name", F.lit(" lead")))
    places = F.when(k % 3 == 0, F.concat("n_name", F.lit(", Pune ,"))).when(k % 3 == 1, F.lit("India"))
    return c.join(n, "c_nationkey").select(
        k.cast("string").alias("id"), k.alias("ord"), titles.alias("suggested_job_titles"),
        places.alias("target_locations"))


QUERIES_SQL = f"""seekers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_custkey AS ord,
    [CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) || ' ' END, n_name || ' lead'] AS titles,
    CASE c_custkey % 3 WHEN 0 THEN [lower(n_name), 'pune'] WHEN 1 THEN ['india']
      ELSE string_split('{CITIES}', '|') END AS places
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
per AS (
  SELECT user_id, ord, 'linkedin' AS platform, titles, places FROM seekers UNION ALL
  SELECT user_id, ord, 'naukri', titles, ['India'] FROM seekers),
kw AS (SELECT *, unnest(titles) AS keyword, generate_subscripts(titles, 1) AS kp FROM per),
queries AS (
  SELECT user_id, ord, platform, keyword, unnest(places) AS location, kp, generate_subscripts(places, 1) AS pp FROM kw),
keyed AS (SELECT *, lower(trim(keyword)) || ':' || lower(trim(location)) AS task_key FROM queries),
tasks AS (
  SELECT platform, task_key, arg_min(keyword, (ord, kp, pp)) AS keyword, arg_min(location, (ord, kp, pp)) AS location,
    min((ord, kp, pp)) AS first_at, count(*) AS n_users FROM keyed GROUP BY platform, task_key)"""


@query(I.with_(QUERIES_SQL) + """
SELECT platform, task_key, keyword, location, n_users,
  CASE lower(location) WHEN 'bengaluru' THEN '90009633' WHEN 'hyderabad' THEN '90009650' WHEN 'mumbai' THEN '90009639'
    WHEN 'delhi' THEN '106187582' WHEN 'gurugram' THEN '115884833' WHEN 'noida' THEN '104869687'
    WHEN 'pune' THEN '114806696' WHEN 'chennai' THEN '106888327' WHEN 'india' THEN '102713980' END AS geo_id
FROM tasks""")
def search_tasks(spark, sf):
    tasks = S.search_tasks(S.user_queries(_seekers(spark, sf), order="ord"))
    return tasks.select("platform", "task_key", "keyword", "location", "n_users", "geo_id")


@query(I.with_(QUERIES_SQL) + """
SELECT platform, task_key, part, string_agg(user_id, ',' ORDER BY ord, kp, pp) AS user_ids FROM (
  SELECT *, (row_number() OVER (PARTITION BY platform, task_key ORDER BY ord, kp, pp) - 1) // 50 + 1 AS part FROM keyed)
GROUP BY platform, task_key, part""")
def task_user_lists(spark, sf):
    """Subscriber lists in parts of 50."""
    members = S.task_members(S.user_queries(_seekers(spark, sf), order="ord"))
    lists = S.task_user_lists(members, size=50, block=256)
    return lists.select("platform", "task_key", "part", F.array_join("user_ids", ",").alias("user_ids"))


@query(I.with_(QUERIES_SQL) + """
SELECT platform, task_key, (n - 1) // CASE platform WHEN 'linkedin' THEN 10 ELSE 3 END + 1 AS batch_no FROM (
  SELECT *, row_number() OVER (PARTITION BY platform ORDER BY first_at) AS n FROM tasks)""")
def task_batches(spark, sf):
    tasks = S.search_tasks(S.user_queries(_seekers(spark, sf), order="ord"))
    return S.task_batches(tasks, block=64).select("platform", "task_key", "batch_no")


@query(I.with_(QUERIES_SQL) + """, t AS (
  SELECT count(*) AS a, count(DISTINCT lower(trim(k))) AS b FROM (SELECT unnest(titles) AS k FROM seekers))
SELECT platform, CAST(sum(n_users) AS BIGINT) AS queries_total, count(*) AS queries_unique,
  CAST(sum(n_users) - count(*) AS BIGINT) AS queries_merged, (SELECT a FROM t) AS titles_total,
  (SELECT b FROM t) AS titles_unique, (SELECT a - b FROM t) AS titles_duplicate FROM tasks GROUP BY platform""")
def task_dedup_stats(spark, sf):
    users = _seekers(spark, sf)
    return S.dedup_stats(users, S.user_queries(users, order="ord"))


@query(I.with_(QUERIES_SQL) + """
SELECT platform, task_key, CASE WHEN platform = 'linkedin' THEN (n_users % 60) || 'hr' END AS date_since_posted,
  CASE WHEN platform = 'naukri' THEN greatest(1, CAST(ceil(n_users % 60 / 24.0) AS BIGINT)) END AS job_age
FROM (SELECT * REPLACE (CASE WHEN n_users % 60 = 0 THEN 24 ELSE n_users % 60 END AS n_users) FROM tasks)""")
def task_lookback(spark, sf):
    tasks = S.search_tasks(S.user_queries(_seekers(spark, sf), order="ord"))
    out = S.dispatch_options(tasks, (F.col("n_users") % 60))
    return out.select("platform", "task_key", "date_since_posted", "job_age")


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS user_id, CAST(p_partkey AS VARCHAR) AS id, 'https://e.org/' || p_partkey AS link,
  p_name AS title, 'site' || (p_partkey % 2) AS platform FROM nation JOIN part ON p_partkey % 5 = n_regionkey""")
def fan_out_round_trip(spark, sf):
    """Parts as postings of a region's task, landed for every nation of the region and read back."""
    root = scratch_path(spark, "landing")
    members = I.table(spark, sf, "nation").select(
        F.col("n_regionkey").cast("string").alias("task_key"), F.col("n_nationkey").cast("string").alias("user_id"))
    key = F.col("p_partkey")
    postings = I.table(spark, sf, "part").select(
        (key % 5).cast("string").alias("task_key"), F.concat(F.lit("site"), key % 2).alias("platform"), F.lit("k").alias("keyword"),
        F.lit("l").alias("location"), F.struct(key.cast("string").alias("id"), F.col("p_name").alias("position"),
                                               F.concat(F.lit("https://e.org/"), key).alias("jobUrl")).alias("job"))
    write_fan_out(postings, members, root, I.now())
    return read_raw_batches(spark, root).select("user_id", "id", "link", "title", "platform")


@query("""
SELECT c_mktsegment AS task_key, CAST(c_custkey AS VARCHAR) AS user_id, count(*) AS copies FROM customer
JOIN part ON p_brand = 'Brand#' || (1 + length(c_mktsegment)) GROUP BY ALL""")
def fan_out_copies(spark, sf):
    """Parts as the results of a task, delivered to every customer of the segment behind it."""
    members = I.table(spark, sf, "customer").select(
        F.concat(F.lit("Brand#"), (F.length("c_mktsegment") + 1).cast("string")).alias("task_key"),
        F.concat_ws("/", "c_mktsegment", F.col("c_custkey").cast("string")).alias("user_id"))
    postings = I.table(spark, sf, "part").select(F.col("p_brand").alias("task_key"), F.col("p_partkey").alias("job"))
    copies = fan_out_counts(postings, members)
    owner = F.split("user_id", "/")
    return copies.select(owner[0].alias("task_key"), owner[1].alias("user_id"), "copies")


SEVEN_SQL = """seekers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey * 37 % 50 AS INTEGER)) END AS created,
    [c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'Lead' ELSE ' LEAD' END, 'job' || c_custkey % 50, 'work' || c_custkey % 40, 'role' || c_custkey % 30,
     'sixth' || c_custkey % 5, 'seventh'] AS titles FROM customer),
kw AS (SELECT user_id, created, unnest(titles[1:5]) AS keyword, generate_subscripts(titles[1:5], 1) AS kp FROM seekers)"""


@query(I.with_(SEVEN_SQL) + """
SELECT lower(trim(keyword)) || ':india' AS task_key, count(*) AS n_users,
  arg_min(keyword, (created IS NOT NULL, coalesce(created, TIMESTAMP '1970-01-01'), user_id, kp)) AS keyword FROM kw GROUP BY 1""")
def title_tasks(spark, sf):
    """Users with seven titles: the first five count, and the spelling of the user who was created first."""
    k = F.col("c_custkey")
    title = lambda name, n: F.concat(F.lit(name), (k % n).cast("string"))
    users = I.table(spark, sf, "customer").select(
        k.cast("string").alias("id"),
        F.when(k % 11 != 0, F.timestamp_seconds(F.lit(1704067200) + (k * 37 % 50) * 86400)).alias("created_at"),
        F.array("c_mktsegment", F.when(k % 2 == 0, "Lead").otherwise(" LEAD"), title("job", 50), title("work", 40), title("role", 30),
                title("sixth", 5), F.lit("seventh")).alias("suggested_job_titles"), F.lit(None).cast("string").alias("target_locations"))
    return S.search_tasks(S.user_queries(users, ("naukri",))).select("task_key", "n_users", "keyword")
