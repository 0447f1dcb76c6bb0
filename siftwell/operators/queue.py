"""The post queue: messages, owner check, release slots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.constants import QUEUE_EXPIRY_DAYS, SLOT_MINUTES
from siftwell.functions.render import post_text
from siftwell.functions.text import truthy
from siftwell.operators.keyed import attach, rank_per_key, split_buckets, top_per_key
from siftwell.session import materialize

MESSAGE_FIELDS = {  # message field -> column
    "title": "title", "companyName": "company_name", "link": "link",
    "aiJobLocation": "ai_job_location", "location": "location",
    "requiredSkills": "required_skills", "preferredSkills": "preferred_skills",
    "minRequiredYoe": "min_required_yoe", "maxRequiredYoe": "max_required_yoe",
    "employmentType": "employment_type", "seniorityLevel": "seniority_level", "salary": "salary",
    "aiDirectApply": "direct_apply",
}
MESSAGE_TYPES = (
    "platform string, userId string, job struct<title:string,companyName:string,link:string,"
    "aiJobLocation:string,location:string,requiredSkills:array<string>,preferredSkills:array<string>,"
    "minRequiredYoe:double,maxRequiredYoe:double,employmentType:string,seniorityLevel:string,"
    "salary:string,aiDirectApply:string>"
)


def with_credentials(users: DataFrame) -> DataFrame:
    """Users that can post: token and person id both present."""
    c = F.col("credentials")
    return users.filter(truthy(c["accessToken"]).isNotNull() & truthy(c["personUrn"]).isNotNull())


def build_post_messages(matched: DataFrame, users: DataFrame, platform: str = "linkedin") -> DataFrame:
    """(user_id, ord, message) for matched postings of users that can post."""
    owners = with_credentials(users).select(F.col("id").alias("user_id"))
    job = F.struct(*[F.col(c).alias(f) for f, c in MESSAGE_FIELDS.items()])
    body = F.to_json(F.struct(
        F.lit(platform).alias("platform"), F.col("user_id").cast("string").alias("userId"), job.alias("job")))
    return attach(matched, owners, "user_id").select("user_id", "ord", body.alias("message"))


def read_messages(queue: DataFrame) -> DataFrame:
    """Unpack message bodies; unreadable ones are dropped."""
    body = F.from_json("message", MESSAGE_TYPES, {"mode": "PERMISSIVE"})
    back = [F.col(f"_b.job.{f}").alias(c) for f, c in MESSAGE_FIELDS.items()]
    return (
        queue.withColumn("_b", body).filter(F.col("_b.userId").isNotNull())
        .select(*[c for c in queue.columns if c not in ("message", "user_id")],
                F.col("_b.userId").alias("user_id"), F.col("_b.platform").alias("platform"), *back)
    )


def post_status(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Add owner data and ``status``: unknown_user, no_credentials, or ready with the post text."""
    c = F.col("credentials")
    owners = users.select(
        F.col("id").alias("user_id"), F.lit(True).alias("_known"), "phone", "post_template",
        (truthy(c["accessToken"]).isNotNull() & truthy(c["personUrn"]).isNotNull()).alias("_can"))
    joined = attach(messages, owners, "user_id", how="left")
    status = (F.when(F.col("_known").isNull(), "unknown_user")
              .when(~F.col("_can"), "no_credentials").otherwise("ready"))
    return joined.withColumn("status", status).withColumn(
        "post", F.when(F.col("status") == "ready", post_text("post_template", "phone"))
    ).drop("_known", "_can", "phone", "post_template")


MOMENT_ROWS = 100_000


def release_slots(queue: DataFrame, start, order=("enqueued_at", "item_id"), bucket=None,
                  minutes: int = SLOT_MINUTES, moment_rows: int = MOMENT_ROWS) -> DataFrame:
    """Add the release slot: one item per user and slot, oldest first.

    The n-th item of a user leaves at ``start + (n - 1) * minutes``; nothing expires (``releases`` is the form
    with expiry). A user with a huge backlog is ranked in buckets of a minute, not in one task, and a moment
    with more than ``moment_rows`` of them (one run may post all at one moment) in ranges of a numeric item id.
    """
    if bucket is None:
        minute = F.date_trunc("minute", order[0])
        queue, part = split_buckets(queue, ["user_id"], minute, order, moment_rows)
        bucket = [minute, part]
    ranked = rank_per_key(queue, ["user_id"], list(order), bucket, "slot_no")
    at = F.timestamp_micros(F.unix_micros(start) + (F.col("slot_no") - 1) * minutes * 60_000_000)
    return ranked.withColumn("release_at", at).drop("_cuts")


# --- slots with expiry ---------------------------------------------------------------------
#
# The queue of a user is first in, first out with one release per slot, and an item that would wait longer
# than the queue keeps messages expires and takes no slot. An item that arrives with own slot o (the first
# after its arrival) and last slot l (the last before it expires) changes the user's next free slot f to
# max(f, min(l + 1, max(f, o) + 1)). Items with the same o and l do so together: c of them change it to
# max(f, min(l + 1, max(f, o) + c)), and the first few get the slots from max(f, o) on. There are at most two
# such groups for each slot of time, so a user's items are counted by many tasks and only these counts are
# gone through in order; and a group releases no more items than slots fit into the keeping time, so ranks
# beyond that are never worked out.

PLAN = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("own", T.LongType()), T.StructField("last", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("first", T.LongType()), T.StructField("taken", T.LongType()),
    T.StructField("free", T.LongType()),
])


def slot_groups(items: DataFrame, minutes: int, keep_days: float, start_ms: int = 0) -> DataFrame:
    """``items`` with own and last, numbers of slots; slot 0 is at ``start_ms``, none lies before it."""
    slot, keep = minutes * 60_000, int(keep_days * 86_400_000)
    since = F.unix_millis("enqueued_at") - F.lit(start_ms)
    return items.withColumns({
        "own": F.greatest(F.ceil(since / slot).cast("bigint"), F.lit(0 if start_ms else None).cast("bigint")),
        "last": F.floor((since + keep) / slot).cast("bigint")})


def plan_groups(grouped: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """One row for each user, own and last: n items, the slot first of the first one released, how many are
    taken, and the user's next free slot after them. ``free`` (user_id, free) is where users stand."""
    counts = grouped.groupBy("user_id", "own", "last").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.lit(None).cast("bigint")) if free is None else \
        counts.join(free.select("user_id", F.col("free").alias("before")), "user_id", "left")
    user_type = counts.schema["user_id"].dataType
    schema = T.StructType([T.StructField("user_id", user_type), *PLAN.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, at = object(), None
        for batch in batches:
            first, taken, left = [], [], []
            for who, own, last, n, before in zip(*(batch.column(c).to_pylist() for c in ("user_id", "own", "last", "n", "before"))):
                if who != user:
                    user, at = who, before
                start = own if at is None else max(at, own)
                k = min(max(last + 1 - start, 0), n)
                at = start + k if k else at
                first.append(start)
                taken.append(k)
                left.append(at)
            columns = [batch.column(c) for c in ("user_id", "own", "last", "n")]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(x, pa.int64()) for x in (first, taken, left))], names=[f.name for f in schema])

    return before.repartition("user_id").sortWithinPartitions("user_id", "own", "last").mapInArrow(run, schema)


def apply_plan(grouped: DataFrame, plan: DataFrame, minutes: int, keep_days: float, start_ms: int = 0) -> DataFrame:
    """``grouped`` items with release_at (null: expired) and expired; own and last are dropped."""
    key, order = ["user_id", "own", "last"], ["enqueued_at", "item_id"]
    most = int(keep_days * 1440 // minutes) + 1
    columns = [c for c in grouped.columns if c not in ("own", "last")]
    ranked = top_per_key(grouped, key, order, most, "_rank").join(plan.select(*key, "first", "taken"), key)
    slot = (F.col("first") + F.col("_rank") - 1) * minutes * 60_000 + F.lit(start_ms)
    released = ranked.where(F.col("_rank") <= F.col("taken")).select(*columns, F.timestamp_millis(slot).alias("release_at"), F.lit(False).alias("expired"))
    # what comes after the last item taken of a group that could not take all
    ends = ranked.where(F.col("_rank") == F.col("taken")).select(*key, F.struct(*order).alias("_end"))
    short = plan.where(F.col("taken") < F.col("n")).select(*key).join(ends, key, "left")
    expired = grouped.join(short, key).where(F.col("_end").isNull() | (F.struct(*order) > F.col("_end"))) \
        .select(*columns, F.lit(None).cast("timestamp").alias("release_at"), F.lit(True).alias("expired"))
    return released.unionAll(expired)


def releases(queue: DataFrame, start=None, minutes: int = SLOT_MINUTES, keep_days: float = QUEUE_EXPIRY_DAYS) -> DataFrame:
    """``queue`` (user_id, item_id, enqueued_at, more) with release_at and expired.

    Slots lie every ``minutes``; with ``start`` (a datetime) the first is then and the whole backlog waits for
    it, otherwise they lie at whole multiples and items may leave from their arrival on. ``item_id`` tells
    items of a user and moment apart. Rows without a user or an arrival are dropped. Columns may not be
    called own, last, release_at or expired.
    """
    start_ms = 0 if start is None else int(start.timestamp() * 1000)
    grouped = slot_groups(queue.where(F.col("user_id").isNotNull() & F.col("enqueued_at").isNotNull()), minutes, keep_days, start_ms)
    return apply_plan(grouped, materialize(plan_groups(grouped), "plan"), minutes, keep_days, start_ms)
