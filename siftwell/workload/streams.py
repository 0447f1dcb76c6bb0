"""Streaming forms, replaying whole tables from files until nothing is left."""

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.queue import releases
from siftwell.schemas import LEDGER
from siftwell.session import scratch_path
from siftwell.sources import folders
from siftwell.streaming import seen, throttle
from siftwell.streaming.clicks import daily_activity, running_clicks
from siftwell.streaming.ingest import append_ledger, start_ingest, stored_ledger
from siftwell.streaming.seen import drop_late
from siftwell.workload import query
from siftwell.workload import inputs as I
from siftwell.workload.matching import CASCADE_SQL
from siftwell.workload.reports import CENTS


def title_model(context: dict, items: list[dict]) -> dict:
    return {"results": [{"id": i["id"], "required_skills": i["title"].split()[:2]} for i in items]}


def stream_table(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of files; a pattern, as the file source takes
    a single file by no plain path."""
    schema = I.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/{name}.parque[t]")


def run_to_files(stream, name):
    """Append-mode query into files of the shared folder; returns what was written."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state) \
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream, name):
    """Complete-mode query; each trigger replaces the result table in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def replace(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.foreachBatch(replace).option("checkpointLocation", state) \
        .outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def replayed(table, name, trigger):
    """Stream of a whole table with one file for each value of ``trigger`` (from 0), read one a trigger in that order.

    Written once; the files' times give the order, as the file source takes older files first."""
    spark = table.sparkSession
    path = scratch_path(spark, name)
    table.withColumn("_trigger", trigger).repartition("_trigger").write.partitionBy("_trigger").parquet(path)
    for folder in folders.children(spark, path):
        if "=" in folder:
            for part in folders.children(spark, f"{path}/{folder}"):
                folders.set_time(spark, f"{path}/{folder}/{part}", 1_700_000_000_000 + 1000 * int(folder.split("=")[1]))
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


#: Every seventh event arrives one to three triggers (three days each) after its time's.
ARRIVAL_SQL = """least(9, datediff('day', TIMESTAMP '2024-01-01', ts) // 3
  + CASE WHEN event_id % 7 = 0 THEN 1 + event_id % 3 ELSE 0 END)"""


@query(f"""
WITH RECURSIVE arrived AS (
  SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {ARRIVAL_SQL}, ts) AS n FROM events),
firsts AS (
  SELECT user_id, event_type, ts, n FROM arrived WHERE n = 1
  UNION ALL
  SELECT * FROM (SELECT f.user_id, f.event_type, min_by(a.ts, a.n) AS ts, min(a.n) AS n FROM firsts f
    JOIN arrived a ON a.user_id = f.user_id AND a.event_type = f.event_type AND a.n > f.n AND a.ts >= f.ts + INTERVAL 14 DAY
    GROUP BY f.user_id, f.event_type, f.n))
SELECT user_id, sha256(event_type) AS fingerprint, strftime(ts, '%Y-%m-%d %H:%M:%S') AS first_at FROM firsts""")
def stream_dedup(spark, sf):
    """First sights of user and content over ten triggers, some rows late; a content counts as new again after 14 days."""
    arrival = F.expr(ARRIVAL_SQL.replace("datediff('day', TIMESTAMP '2024-01-01', ts) // 3", "datediff(scraped_at, DATE '2024-01-01') div 3")
                     .replace("event_id", "_id"))
    rows = I.table(spark, sf, "events").select(
        "user_id", F.sha2("event_type", 256).alias("fingerprint"), F.col("ts").cast("timestamp").alias("scraped_at"), F.col("event_id").alias("_id"))
    stream = replayed(rows, "events", arrival)
    root = scratch_path(spark, "dedup")
    seen.start_first_seen(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return seen.seen_rows(spark, f"{root}/out", stream.schema).select(
        "user_id", "fingerprint", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"))


@query(I.with_(I.CLICKS_SQL) + """
SELECT coalesce(c.user_id, CAST(o_custkey AS VARCHAR)) AS user_id, key, count(*) AS clicks FROM clicks c
LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = c.job_id
WHERE key IS NOT NULL AND coalesce(c.user_id, CAST(o_custkey AS VARCHAR)) IS NOT NULL GROUP BY ALL""")
def stream_clicks(spark, sf):
    rows = I.clicks_from(stream_table(spark, sf, "events"))
    return run_complete(running_clicks(rows, I.scored(spark, sf).select("id", "user_id")), "clicks")


@query(I.with_(I.RUNS_SQL) + f"""
SELECT strftime(run_at + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, event_type, count(*) AS runs_count,
  {CENTS('actual_cost_usd')} AS total_cost_usd FROM runs GROUP BY ALL""")
def stream_daily(spark, sf):
    rows = stream_table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("run_at"), F.col("value").alias("actual_cost_usd"), "event_type")
    return run_complete(daily_activity(rows, ["event_type"]), "daily")


@query(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
WHERE o_orderpriority = '5-LOW' OR o_orderdate >= TIMESTAMP '{I.RETENTION_NOW}' - INTERVAL 14 DAY""")
def stream_fresh(spark, sf):
    """Late postings leave the stream; undated ones stay."""
    dated = F.when(F.col("o_orderpriority") != "5-LOW", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = stream_table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), dated.alias("posted_at"))
    return run_to_files(drop_late(rows, I.now(I.RETENTION_NOW)).select("id"), "fresh")


@query(CASCADE_SQL.replace("WHERE quality = 1", "WHERE quality = 7").replace("es corp", "scoutit") + """
SELECT user_id, fp AS fingerprint, 'https://www.linkedin.com/jobs/view/' || ord AS job_link FROM staged WHERE stage = 'evaluate'""")
def stream_cascade(spark, sf):
    """The whole service on a stream: postings through rules and model into an empty ledger."""
    root = scratch_path(spark, "service")
    postings = I.postings_from(stream_table(spark, sf, "documents"))
    start_ingest(postings, lambda: I.users(spark, sf), f"{root}/ledger", f"{root}/runs", f"{root}/state",
                 title_model, now=I.now).awaitTermination()
    return stored_ledger(spark, f"{root}/ledger").select("user_id", "fingerprint", "job_link")


def halves_model(context: dict, items: list[dict]) -> dict:
    """Facts by the length of the title: the candidate has all skills asked for, or none."""
    return {"results": [{"id": i["id"], "required_skills": i["title"].split()[:2],
                         "candidate_matched_required_skills": i["title"].split()[:2] if len(i["title"]) % 2 == 0 else []} for i in items]}


@query(CASCADE_SQL.replace("WHERE quality = 1", "WHERE quality = 1 AND doc_id % 2 = 1").replace("es corp", "scoutit") + """,
passed AS (SELECT s.user_id, s.ord, length(p.title) % 2 = 0 AS matched FROM staged s JOIN postings p USING (ord) WHERE stage = 'evaluate')
SELECT 'ledger' AS part, user_id, count(*) AS n FROM passed GROUP BY user_id
UNION ALL SELECT 'history', user_id, count(*) FROM history GROUP BY user_id
UNION ALL SELECT 'runs', user_id, 1 FROM counts
UNION ALL SELECT 'user_counters', user_id, 1 FROM counts
UNION ALL SELECT unnest(['described', 'descriptions', 'digest']), user_id, count(*) FROM passed WHERE matched GROUP BY user_id
UNION ALL SELECT 'last_rank', user_id, count(*) FROM passed WHERE matched GROUP BY user_id
UNION ALL SELECT 'posts', user_id, count(*) FROM passed WHERE matched AND CAST(user_id AS BIGINT) % 2 = 0 GROUP BY user_id""")
def stream_service(spark, sf):
    """All tables a run leaves, by user: half of the starting ledger is past its retention, half the users can post."""
    root = scratch_path(spark, "service")
    old = F.regexp_extract("job_link", r"(\d+)$", 1).cast("bigint") % 2 == 0
    history = I.history(spark, sf).withColumn("created_at", F.when(old, I.now() - F.expr("INTERVAL 30 DAYS")).otherwise(I.now() - F.expr("INTERVAL 1 DAY")))
    history = history.select(*(f.name if f.name in history.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LEDGER))
    append_ledger(history, f"{root}/ledger", -1)
    token = F.when(F.col("id").cast("bigint") % 2 == 0, "t")
    users = I.users(spark, sf).withColumn("credentials", F.struct(
        token.alias("accessToken"), F.lit(None).cast("string").alias("refreshToken"), F.lit("urn").alias("personUrn")))
    postings = I.postings_from(stream_table(spark, sf, "documents"))
    start_ingest(postings, lambda: users, f"{root}/ledger", f"{root}/runs", f"{root}/state", halves_model, now=I.now,
                 tables=f"{root}/tables", app_url="https://app").awaitTermination()

    def counted(rows, part, n=F.count(F.lit(1))):
        return rows.groupBy("user_id").agg(n.cast("bigint").alias("n")).select(F.lit(part).alias("part"), "user_id", "n")

    # what is left of the history's files: those of old days are gone
    history = stored_ledger(spark, f"{root}/ledger").filter("batch_id < 0")
    ledger = stored_ledger(spark, f"{root}/ledger").filter("batch_id >= 0")
    left = {name: spark.read.parquet(f"{root}/tables/{name}") for name in ("descriptions", "digest", "posts", "user_counters")}
    parts = [counted(history, "history"), counted(ledger, "ledger"), counted(ledger.filter("description_key IS NOT NULL"), "described"),
             counted(spark.read.parquet(f"{root}/runs"), "runs"), counted(left["digest"], "last_rank", F.max("rank"))]
    for name, rows in left.items():
        parts.append(counted(rows, name, F.sum("runs")) if name == "user_counters" else counted(rows, name))
    return reduce(DataFrame.unionByName, parts)


@query("""
WITH q AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  CAST(ceil((epoch_us(ts) // 1000) / 1800000.0) AS BIGINT) AS slot FROM events)
SELECT event_id AS item_id, user_id,
  strftime(make_timestamp((n + max(slot - n) OVER (PARTITION BY user_id ORDER BY n)) * 1800000000), '%Y-%m-%d %H:%M:%S') AS release_at
FROM q""")
def stream_throttle(spark, sf):
    rows = stream_table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp").alias("enqueued_at"))
    out = scratch_path(spark, "throttle")
    throttle.start_throttle(rows, f"{out}/releases", f"{out}/state").awaitTermination()
    return throttle.released(spark, f"{out}/releases").select(
        "item_id", "user_id", F.date_format("release_at", "yyyy-MM-dd HH:mm:ss").alias("release_at"))


#: A user with a third of all items and six others, all with more items than slots; kept for four days.
BUSY_SQL = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + user_id % 6 END"
#: Recursion over groups of items with one own and one last slot: f is the next free slot after each.
EXPIRY_SQL = """
WITH RECURSIVE items AS (SELECT event_id AS item_id, {user} AS user_id, ts, {own} AS own, {last} AS last FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, own, last ORDER BY ts, item_id) AS r FROM items),
groups AS (SELECT user_id, own, last, count(*) AS c, row_number() OVER (PARTITION BY user_id ORDER BY own, last) AS k FROM items GROUP BY user_id, own, last),
plan AS (
  SELECT user_id, k, own AS first, least(greatest(last + 1 - own, 0), c) AS taken, CASE WHEN last >= own THEN own + least(last + 1 - own, c) ELSE 0 END AS f
  FROM groups WHERE k = 1
  UNION ALL
  SELECT g.user_id, g.k, greatest(p.f, own), least(greatest(last + 1 - greatest(p.f, own), 0), c),
    CASE WHEN last >= greatest(p.f, own) THEN greatest(p.f, own) + least(last + 1 - greatest(p.f, own), c) ELSE p.f END
  FROM plan p JOIN groups g ON g.user_id = p.user_id AND g.k = p.k + 1)
SELECT item_id, user_id, r > taken AS expired,
  CASE WHEN r <= taken THEN strftime(make_timestamp({start} + (first + r - 1) * 1800000000), '%Y-%m-%d %H:%M:%S') END AS release_at
FROM ranked JOIN groups USING (user_id, own, last) JOIN plan USING (user_id, k)"""


def busy(spark, sf):
    return I.table(spark, sf, "events").select(
        F.expr(BUSY_SQL).cast("bigint").alias("user_id"), F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp").alias("enqueued_at"))


@query(EXPIRY_SQL.format(user=BUSY_SQL, start=0, own="CAST(ceil((epoch_us(ts) // 1000) / 1800000.0) AS BIGINT)",
                         last="((epoch_us(ts) // 1000) + 345600000) // 1800000"))
def stream_throttle_expiry(spark, sf):
    """Five triggers of users with more items than slots: most items expire, one user has a third of them."""
    stream = replayed(busy(spark, sf), "busy", F.expr("datediff(enqueued_at, DATE '2024-01-01') div 6"))
    out = scratch_path(spark, "throttle")
    throttle.start_throttle(stream, f"{out}/releases", f"{out}/state").awaitTermination()
    return throttle.released(spark, f"{out}/releases").select(
        "item_id", "user_id", "expired", F.date_format("release_at", "yyyy-MM-dd HH:mm:ss").alias("release_at"))


@query(EXPIRY_SQL.format(
    user=BUSY_SQL, start="epoch_us(TIMESTAMP '2024-01-20 00:00:00')",
    own="greatest(0, CAST(ceil((epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-20 00:00:00')) / 1800000.0) AS BIGINT))",
    last="CAST(floor((epoch_us(ts) // 1000 + 345600000 - epoch_ms(TIMESTAMP '2024-01-20 00:00:00')) / 1800000.0) AS BIGINT)"))
def post_release_expiry(spark, sf):
    """The batch form: a backlog that waits for the first slot, what it keeps too long, and what arrives later."""
    return releases(busy(spark, sf), datetime(2024, 1, 20, tzinfo=timezone.utc)).select(
        "item_id", "user_id", "expired", F.date_format("release_at", "yyyy-MM-dd HH:mm:ss").alias("release_at"))
