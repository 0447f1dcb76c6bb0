"""Users: selection, change feed, subscriptions, run counters, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.constants import FREE, PREMIUM, TRIAL_DAYS
from siftwell.functions.render import expiry_notice
from siftwell.functions.text import trim_ws

UUID = "^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SCRAPING_COLUMNS = ["id", "suggested_job_titles", "target_locations"]
FAN_OUT_COLUMNS = ["id", "email", "is_active", "chat_id", "tier", "subscription_expires_at"]


def active_users(users: DataFrame, tier: str | None = None, cols=SCRAPING_COLUMNS) -> DataFrame:
    """Active users, optionally of one tier, with only the needed columns."""
    out = users.filter(F.col("is_active"))
    if tier:
        out = out.filter(F.col("tier") == tier)
    return out.select(*cols)


def is_expired(now: Column) -> Column:
    return (
        (F.col("tier") == PREMIUM) & F.col("subscription_expires_at").isNotNull()
        & (F.col("subscription_expires_at") < now) & F.col("is_active")
    )


def expired(users: DataFrame, now: Column, user_id: str | None = None) -> DataFrame:
    out = users.filter(is_expired(now))
    return out.filter(F.col("id") == user_id) if user_id else out


def downgrade_expired(users: DataFrame, now: Column, user_id: str | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """(all users after the downgrade, the changed ones with their notice text)."""
    hit = F.coalesce(is_expired(now), F.lit(False))
    if user_id:
        hit = hit & (F.col("id") == user_id)
    after = (
        users.withColumn("_hit", hit)
        .withColumns({
            "tier": F.when(F.col("_hit"), F.lit(FREE)).otherwise(F.col("tier")),
            "subscription_expires_at": F.when(~F.col("_hit"), F.col("subscription_expires_at")),
            "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at")),
        })
        .drop("_hit")
    )
    changed = users.filter(hit).select(
        "id", "chat_id", "subscription_amount", expiry_notice("subscription_amount").alias("notice"))
    return after, changed


def create_defaults(now: Column) -> dict[str, Column]:
    """Values of a newly created user where the request gives none."""
    return {
        "tier": F.lit(PREMIUM),
        "subscription_amount": F.lit(0.0),
        "subscription_expires_at": now + F.expr(f"INTERVAL {TRIAL_DAYS} DAYS"),
        "experience_years": F.lit(0.0),
        "exclude_title_keywords": F.array().cast("array<string>"),
        "is_active": F.lit(True),
        "total_runs_count": F.lit(0),
        "telegram_apply_clicks": F.lit(0),
        "telegram_resume_clicks": F.lit(0),
        "dashboard_apply_clicks": F.lit(0),
        "dashboard_resume_clicks": F.lit(0),
    }


def apply_user_changes(users: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Fold a change feed (id, op, ts, any user columns) into the users table.

    ``op`` is 'create' or 'update'. Per user and column the latest non-null value wins; of changes at the
    same ts the one with the larger ``seq``, if the feed has that column, then the larger value. Creates of
    unknown ids become rows with defaults; updates of unknown ids do nothing. Grouping combines on
    the map side, so a user with very many changes is no problem.
    """
    fields = [c for c in changes.columns if c not in ("id", "op", "ts", "seq") and c in users.columns]
    age = [F.col("ts"), F.col("seq") if "seq" in changes.columns else F.lit(0)]
    latest = changes.groupBy("id").agg(
        F.bool_or(F.col("op") == "create").alias("_create"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*age, F.col(c).cast("string")))).alias(f"_new_{c}") for c in fields],
    )
    joined = users.withColumn("_old", F.lit(True)).join(latest, "id", "full_outer")
    joined = joined.filter(F.col("_old") | F.col("_create"))
    is_new, touched = F.col("_old").isNull(), F.col("_create").isNotNull()
    defaults = create_defaults(now)
    out = []
    for c in users.columns:
        if c == "id":
            out.append(F.col("id"))
            continue
        value = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in fields else F.col(c)
        if c in defaults:
            value = F.when(is_new, F.coalesce(value, defaults[c].cast(users.schema[c].dataType))).otherwise(value)
        elif c == "created_at":
            value = F.when(is_new, now).otherwise(value)
        elif c == "updated_at":
            value = F.when(touched, now).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def run_counters(runs: DataFrame) -> DataFrame:
    """Successful runs and last successful run per user."""
    ok = F.col("status") == "SUCCESS"
    return runs.groupBy("user_id").agg(
        F.count_if(ok).alias("runs"), F.max(F.when(ok, F.col("run_at"))).alias("last_run"))


def refresh_user_counters(users: DataFrame, runs: DataFrame) -> DataFrame:
    """Add this call's successful runs to the lifetime counter and move the last-run time."""
    counts = run_counters(runs).withColumnRenamed("user_id", "id")
    return (
        users.join(counts, "id", "left")
        .withColumns({
            "total_runs_count": (F.col("total_runs_count") + F.coalesce("runs", F.lit(0))).cast("int"),
            "last_run_at": F.greatest("last_run_at", "last_run"),
        })
        .drop("runs", "last_run")
    )


def resolve_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``user_id`` to requests (identifier): a uuid is taken as it is, anything else is looked
    up as an e-mail address without regard to case; unknown ones get null. Where several users have an
    address, the smallest id is taken."""
    ident = trim_ws("identifier")
    is_id = ident.rlike(UUID) & ~F.contains(ident, F.lit("@"))
    mails = users.groupBy(F.lower("email").alias("_mail")).agg(F.min("id").alias("_found"))
    # requests that need no lookup get a key of their own; nulls would all meet in one task
    blank = F.coalesce(F.trim(ident), F.lit("")) == ""
    own = F.concat(F.lit("blank:"), F.xxhash64(*requests.columns).cast("string"))
    wanted = requests.withColumn("_mail", F.when(is_id, F.concat(F.lit("id:"), ident)).when(blank, own).otherwise(F.lower(ident)))
    return wanted.join(mails, "_mail", "left").withColumn(
        "user_id", F.when(is_id, ident).otherwise(F.col("_found"))).drop("_mail", "_found")
