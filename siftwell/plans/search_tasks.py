"""Search planning: one task per keyword and place, shared by all users who want it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.constants import (
    DEFAULT_LOCATIONS, GEO_IDS, SINGLE_LOCATION_PLATFORMS, TASK_BATCH_SIZES, TITLES_PER_USER,
)
from siftwell.functions.fit import strings
from siftwell.functions.links import lookback_days
from siftwell.functions.text import trim_ws
from siftwell.operators.keyed import batch_number, rank_per_key
from siftwell.session import materialize


def geo_id(place: Column) -> Column:
    """Site id of a place name, null when unknown."""
    out = F.lit(None).cast("string")
    for name, number in GEO_IDS.items():
        out = F.when(place == name, F.lit(number)).otherwise(out)
    return out


def _places(target_locations, platform: str) -> Column:
    """Places as array of (name, geo_id): the user's comma list, else the default cities."""
    place = lambda name, number: F.named_struct(F.lit("name"), name, F.lit("geo_id"), number)
    if platform in SINGLE_LOCATION_PLATFORMS:
        return F.array(place(F.lit("India"), F.lit(GEO_IDS["india"])))
    own = F.filter(
        F.transform(F.split(F.coalesce(target_locations, F.lit("")), ","), lambda p: F.lower(trim_ws(p))),
        lambda p: p != "")
    own = F.transform(own, lambda p: place(p, geo_id(p)))
    default = F.array(*[place(F.lit(n), F.lit(g)) for n, g in DEFAULT_LOCATIONS])
    return F.when(F.size(own) > 0, own).otherwise(default)


def user_queries(users: DataFrame, platforms=("linkedin", "naukri"), order: str = "created_at") -> DataFrame:
    """Every (platform, keyword, place) a user asks for: the first titles times the places.

    ``order`` is the users' processing order, by default that of their creation with the id for ties; users
    without a time come first. Keyword and place positions extend it to a total order of the queries.
    """
    place = F.struct(F.col(order), F.col("id")) if order == "created_at" else F.col(order)
    titles = F.slice(strings("suggested_job_titles"), 1, TITLES_PER_USER)
    frames = [
        users.select(
            F.col("id").alias("user_id"), place.alias("user_ord"), F.lit(p).alias("platform"),
            _places(F.col("target_locations"), p).alias("places"),
            F.posexplode(titles).alias("keyword_pos", "keyword"))
        for p in platforms
    ]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rows = rows.select("*", F.posexplode("places").alias("place_pos", "place"))
    return rows.select(
        "user_id", "user_ord", "platform", "keyword", F.col("place.name").alias("location"),
        F.col("place.geo_id").alias("geo_id"), "keyword_pos", "place_pos",
        F.concat(F.lower(trim_ws("keyword")), F.lit(":"), F.lower(trim_ws("place.name"))).alias("task_key"))


def _earliest(queries: DataFrame) -> DataFrame:
    """``queries`` of each task's earliest creation time only, where ``user_ord`` is a time and an id, with how
    many asked for the task in all.

    Times and counts are a table of one row a task, stored so that Spark knows its size: where it is small, the
    queries meet it in the tasks that make them and are not moved before they are few."""
    time = queries.schema["user_ord"].dataType.fieldNames()[0]
    # users without a time come first
    since = F.coalesce(F.unix_micros(F.col("user_ord")[time].cast("timestamp")), F.lit(-1 << 63))
    least = queries.groupBy("platform", "task_key").agg(F.min(since).alias("_since"), F.count(F.lit(1)).alias("_n"))
    return queries.withColumn("_since", since).join(materialize(least, "earliest"), ["platform", "task_key", "_since"])


def search_tasks(queries: DataFrame) -> DataFrame:
    """One row per (platform, task_key): the first spelling, how many asked, and where it first came.

    Subscribers are not gathered into the row (a popular search may have any number); they stay in
    ``task_members``. Queries are first combined by spelling and position, where counts and numeric orders are
    kept in a hash table, so a task holds as many rows as it meets different ones; the few combined rows
    are sorted for the first of each task.
    """
    task, spelling = ["platform", "task_key"], ["keyword", "location", "geo_id", "keyword_pos", "place_pos"]
    at = F.struct("user_ord", "keyword_pos", "place_pos")
    first = F.min_by(F.struct("keyword", "location", "geo_id"), at).alias("_f"), F.min(at).alias("first_at")
    if isinstance(queries.schema["user_ord"].dataType, T.StructType):
        tasks = _earliest(queries).groupBy(*task).agg(*first, F.max("_n").alias("n_users"))
    else:
        spelled = queries.groupBy(*task, *spelling).agg(F.min("user_ord").alias("user_ord"), F.count(F.lit(1)).alias("_n"))
        tasks = spelled.groupBy(*task).agg(*first, F.sum("_n").alias("n_users"))
    return tasks.select("platform", "task_key", "_f.keyword", "_f.location", "_f.geo_id", "first_at", "n_users")


def task_members(queries: DataFrame) -> DataFrame:
    """(platform, task_key, user_id) in asking order; a user asking twice is listed twice."""
    return queries.select("platform", "task_key", "user_id", "user_ord", "keyword_pos", "place_pos")


def task_user_lists(members: DataFrame, size: int = 1000, block: int = 4096) -> DataFrame:
    """Subscriber lists in parts of at most ``size`` users, in asking order.

    Ranks come from blocks of the users' order, so the subscribers of one popular task are never
    brought together; concatenating a task's parts gives its whole list.
    """
    ranked = rank_per_key(
        members, ["platform", "task_key"], ["user_ord", "keyword_pos", "place_pos"],
        [F.floor(F.col("user_ord") / block)], "_rank")
    return (
        ranked.withColumn("part", batch_number(F.col("_rank"), size))
        .groupBy("platform", "task_key", "part")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "user_id"))).alias("_users"))
        .withColumn("user_ids", F.transform("_users", lambda u: u["user_id"])).drop("_users")
    )


def task_batches(tasks: DataFrame, sizes: dict[str, int] = TASK_BATCH_SIZES, block: int = 4096) -> DataFrame:
    """Add the dispatch batch of each task: fixed-size batches per platform in task order."""
    ranked = rank_per_key(tasks, ["platform"], ["first_at"],
                          [F.floor(F.col("first_at.user_ord") / block)], "task_no")
    size = F.lit(1)
    for platform, n in sizes.items():
        size = F.when(F.col("platform") == platform, F.lit(n)).otherwise(size)
    return ranked.withColumn("batch_no", (F.floor((F.col("task_no") - 1) / size) + 1).cast("bigint"))


def dispatch_options(tasks: DataFrame, hours) -> DataFrame:
    """Add the look-back settings each platform expects."""
    h = F.lit(hours) if isinstance(hours, int) else hours
    h = F.when(h > 0, h).otherwise(F.lit(24))
    return tasks.withColumns({
        "date_since_posted": F.when(F.col("platform") == "linkedin", F.concat(h.cast("string"), F.lit("hr"))),
        "job_age": F.when(F.col("platform") == "naukri", lookback_days(h)),
    })


def dedup_stats(users: DataFrame, queries: DataFrame) -> DataFrame:
    """Per platform: titles and queries in total, distinct, and merged."""
    titles = users.select(F.explode(F.slice(strings("suggested_job_titles"), 1, TITLES_PER_USER)).alias("t"))
    title_counts = titles.select(F.lower(trim_ws("t")).alias("t")).agg(
        F.count(F.lit(1)).alias("titles_total"), F.countDistinct("t").alias("titles_unique"))
    per_task = queries.groupBy("platform", "task_key").agg(F.count(F.lit(1)).alias("n"))
    stats = per_task.groupBy("platform").agg(
        F.sum("n").alias("queries_total"), F.count(F.lit(1)).alias("queries_unique"))
    return (
        stats.withColumns({
            "titles_total": title_counts.select("titles_total").scalar(),
            "titles_unique": title_counts.select("titles_unique").scalar(),
        })
        .withColumns({
            "titles_duplicate": F.col("titles_total") - F.col("titles_unique"),
            "queries_merged": F.col("queries_total") - F.col("queries_unique"),
        })
    )
