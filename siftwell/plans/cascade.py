"""The matching cascade: landed postings of all users to evaluated ones and a run audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.constants import BLOCKED_COMPANIES, FRESHNESS_DAYS, MIN_DESCRIPTION_CHARS
from siftwell.functions.experience import candidate_years, yoe_reject_reason
from siftwell.functions.fit import evaluate_fit
from siftwell.functions.links import normalize_link
from siftwell.functions.text import fingerprint
from siftwell.operators.dedup import seen_keys
from siftwell.operators.inference import USAGE, ModelFn, call_model, parse_facts
from siftwell.operators.keyed import attach
from siftwell.operators.normalize import candidate_context, extraction_payload
from siftwell.operators.rules import (
    company_blocked, keyword_hits, outdated, posting_complete, seniority_keyword, with_yoe,
)

# Row stages, in the order the rules apply.
BLOCKED, INVALID, KNOWN = "blocked", "invalid", "known"
OUTDATED, KEYWORD, YOE, SENIORITY = "outdated", "keyword", "yoe", "seniority"
EVALUATE = "evaluate"
RULE_STAGES = [OUTDATED, KEYWORD, YOE, SENIORITY, EVALUATE]
#: A posting's order times this, plus the number of its rule stage, is one long.
PACK = 8


def classify(postings: DataFrame, users: DataFrame, now: Column, blocklist=BLOCKED_COMPANIES,
             fresh_days: int = FRESHNESS_DAYS, min_chars: int = MIN_DESCRIPTION_CHARS) -> DataFrame:
    """Row-by-row part: keys, entry check and the first rule each posting fails.

    Everything here depends on one posting and its user's settings, so it runs in the scan stage.
    ``entry_stage`` marks blocked and incomplete postings; ``rule_stage`` is what happens to the
    posting if it turns out to be the first and new one of its key.
    """
    rows = postings.withColumn("entry_stage", F.when(
        company_blocked("company_name", blocklist), BLOCKED).when(
        ~posting_complete(min_chars=min_chars), INVALID))
    rows = with_yoe(rows).withColumns({
        "fingerprint": F.when(F.col("entry_stage").isNull(),
                              fingerprint("title", "company_name", "description_text")),
        "link": normalize_link("link"),
    })
    settings = users.filter(F.col("is_active")).select(
        F.col("id").alias("user_id"), candidate_years("experience_years").alias("candidate_years"),
        "exclude_title_keywords")
    rows = attach(rows, settings, "user_id")
    yoe_out = yoe_reject_reason("yoe_min", "yoe_max", "candidate_years", "fresher").isNotNull()
    return rows.withColumn(
        "rule_stage",
        F.when(outdated("posted_at", now, fresh_days), OUTDATED)
        .when(F.size(keyword_hits("title", "seniority_level", "exclude_title_keywords")) > 0, KEYWORD)
        .when(yoe_out, YOE)
        .when(seniority_keyword("title", "candidate_years").isNotNull(), SENIORITY)
        .otherwise(EVALUATE),
    )


def stage_postings(classified: DataFrame, ledger: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per (user, fingerprint) with ``copies`` and its final ``stage``.

    The first copy in landing order decides. Grouping combines on the map side, so many copies of a
    posting leave a task as one row; blocked and incomplete postings shrink to counts the same way.
    Where ``ord`` is a number, order and rule stage are packed into one long, so the aggregate hashes and
    never sorts. Text columns (``carry``) make rows wide; ``with_texts`` fetches them for survivors later.
    The ledger is joined on the grouping keys, so no further exchange of the postings is needed.
    """
    # Rows stopped at the entry have no fingerprint; their stage name takes its place as the key.
    keyed = classified.withColumn("_key", F.coalesce("entry_stage", "fingerprint"))
    entered = F.col("entry_stage").isNull()
    if isinstance(classified.schema["ord"].dataType, T.IntegralType) and not carry:
        code = F.array_position(F.lit(RULE_STAGES), F.col("rule_stage"))
        packed = F.when(entered, F.col("ord").cast("bigint") * PACK + code)
        found = keyed.groupBy("user_id", "_key").agg(F.count(F.lit(1)).alias("copies"), F.min(packed).alias("_packed"))
        first = found.select("user_id", "_key", "copies", F.struct(
            F.shiftright("_packed", PACK.bit_length() - 1).cast(classified.schema["ord"].dataType).alias("ord"),
            F.get(F.lit(RULE_STAGES), (F.col("_packed").bitwiseAND(F.lit(PACK - 1)) - 1).cast("int")).alias("rule_stage")).alias("_first"))
    else:
        can_pass = F.col("rule_stage") == EVALUATE
        payload = F.struct(
            F.col("ord").alias("ord"), F.col("rule_stage").alias("rule_stage"),
            *[F.when(can_pass, F.col(c)).alias(c) for c in carry])
        first = keyed.groupBy("user_id", "_key").agg(
            F.count(F.lit(1)).alias("copies"), F.min_by(F.when(entered, payload), F.col("ord")).alias("_first"))
    seen = seen_keys(ledger).withColumnRenamed("fingerprint", "_key").distinct().withColumn(
        "_seen", F.lit(True))
    staged = first.join(seen, ["user_id", "_key"], "left")
    stopped = F.col("_key").isin(BLOCKED, INVALID)
    stage = F.when(stopped, F.col("_key")).when(F.col("_seen"), KNOWN).otherwise(
        F.col("_first.rule_stage"))
    return staged.select(
        "user_id", F.when(~stopped, F.col("_key")).alias("fingerprint"), "copies",
        stage.alias("stage"), F.col("_first.ord").alias("ord"),
        *[F.col(f"_first.{c}").alias(c) for c in carry])


def survivors(staged: DataFrame) -> DataFrame:
    return staged.filter(F.col("stage") == EVALUATE)


def with_texts(rows: DataFrame, postings: DataFrame) -> DataFrame:
    """``rows`` (user_id, ord, fingerprint) of survivors with the columns ``CARRY`` of their postings.

    ``ord`` tells a user's postings apart. Where ``rows`` is a stored table, Spark knows its size: under the
    broadcast threshold no text moves at all, above it the texts of postings that a Bloom filter of the
    survivors lets through move once. Links and experience texts are worked out for survivors only.
    """
    found = postings.join(rows.select("user_id", "ord", "fingerprint"), ["user_id", "ord"])
    return with_yoe(found).withColumn("link", normalize_link("link")).select("user_id", "fingerprint", "ord", *CARRY)


def funnel(staged: DataFrame) -> DataFrame:
    """Per user: how many postings each stage took, and how many distinct ones go to evaluation.

    scraped = blocked + invalid + duplicates + known + outdated + keyword + yoe + seniority + evaluated
    """
    rows = lambda s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("copies"))), F.lit(0))
    keys = lambda s: F.count_if(F.col("stage") == s)
    entered = ~F.col("stage").isin(BLOCKED, INVALID)
    return staged.groupBy("user_id").agg(
        F.sum("copies").alias("scraped"),
        rows(BLOCKED).alias("blocked"),
        rows(INVALID).alias("invalid"),
        F.coalesce(F.sum(F.when(entered, F.col("copies") - 1)), F.lit(0)).alias("duplicates"),
        keys(KNOWN).alias("known"), keys(OUTDATED).alias("outdated"), keys(KEYWORD).alias("keyword"),
        keys(YOE).alias("yoe"), keys(SENIORITY).alias("seniority"), keys(EVALUATE).alias("evaluated"),
    )


def with_silent_users(counts: DataFrame, present: DataFrame) -> DataFrame:
    """Add zero counts for users whose files held no readable posting; they get an audit row too."""
    joined = present.select("user_id").distinct().join(counts, "user_id", "left")
    return joined.fillna(0, subset=[c for c in counts.columns if c != "user_id"])


def exit_stage() -> Column:
    """The stage a user's run ended at, from the funnel columns."""
    c = F.col
    after_block = c("scraped") - c("blocked")
    unique = after_block - c("invalid") - c("duplicates")
    new = unique - c("known")
    after_keyword = new - c("outdated") - c("keyword")
    after_yoe = after_keyword - c("yoe")
    return (
        F.when(after_block == 0, "blocked_companies").when(unique == 0, "batch_dedup")
        .when(new == 0, "db_dedup").when(after_keyword == 0, "keyword_filter")
        .when(after_yoe == 0, "yoe_filter").when(after_yoe - c("seniority") == 0, "seniority_filter")
        .otherwise("ai_evaluation")
    )


def audit_rows(counts: DataFrame, outcome: DataFrame | None, run_at: Column) -> DataFrame:
    """Run-audit rows from the funnel and the per-user outcome of evaluation.

    The stored counters follow the service: incomplete postings count as batch duplicates, blocked
    and outdated ones appear nowhere, and the keyword counter includes the experience and seniority
    filters only for runs that end there. ``funnel`` keeps the complete set.
    """
    rows = counts.withColumn("exit_stage", exit_stage())
    zero = {"matched": "bigint", "rejected": "bigint", **{
        u: ("double" if u == "cost_usd" else "bigint") for u in USAGE}}
    if outcome is None:
        rows = rows.withColumns({n: F.lit(0).cast(t) for n, t in zero.items()})
    else:
        rows = rows.join(outcome, "user_id", "left").withColumns(
            {n: F.coalesce(F.col(n), F.lit(0)).cast(t) for n, t in zero.items()})
    stopped = F.col("exit_stage")
    filtered = (
        F.when(stopped == "yoe_filter", F.col("keyword") + F.col("yoe"))
        .when(stopped == "seniority_filter", F.col("keyword") + F.col("yoe") + F.col("seniority"))
        .otherwise(F.col("keyword")))
    return rows.select(
        "user_id", run_at.alias("run_at"), F.lit("SUCCESS").alias("status"),
        F.col("scraped").alias("scraped_jobs_count"),
        (F.col("invalid") + F.col("duplicates")).alias("batch_dedup_count"),
        F.col("known").alias("db_dedup_count"),
        filtered.alias("keyword_filtered_count"),
        F.col("rejected").alias("rejected_jobs_count"), F.col("matched").alias("matched_jobs_count"),
        F.col("cost_usd").alias("actual_cost_usd"),
        (F.col("cache_hit_tokens") + F.col("cache_miss_tokens")).alias("input_tokens"),
        F.col("cache_hit_tokens").alias("input_cache_hit_tokens"),
        F.col("completion_tokens").alias("output_tokens"),
        F.col("reasoning_tokens"), F.lit(None).cast("string").alias("error_message"), "exit_stage",
    )


def failed_runs(user_ids: DataFrame, message: str, run_at: Column) -> DataFrame:
    """Audit rows of users whose job failed; the error text is cut to its column width."""
    zero = F.lit(0).cast("bigint")
    return user_ids.select(
        "user_id", run_at.alias("run_at"), F.lit("FAILED").alias("status"),
        *[zero.alias(c) for c in ("scraped_jobs_count", "batch_dedup_count", "db_dedup_count",
                                  "keyword_filtered_count", "rejected_jobs_count", "matched_jobs_count")],
        F.lit(0.0).alias("actual_cost_usd"),
        *[zero.alias(c) for c in ("input_tokens", "input_cache_hit_tokens", "output_tokens",
                                  "reasoning_tokens")],
        F.lit(message[:1024]).alias("error_message"), F.lit("catch_error").alias("exit_stage"))


CARRY = [
    "link", "title", "company_name", "location", "posted_at", "salary", "description_text",
    "applicants_count", "apply_url", "seniority_level", "employment_type", "job_function",
    "industries", "benefits", "source", "extracted_yoe_text",
]


def evaluate(rows: DataFrame, users: DataFrame, fn: ModelFn, batch_size: int = 5,
             parallelism: int | None = None) -> DataFrame:
    """Facts, category, score and skill lists of the surviving postings."""
    context = candidate_context(users)
    context = context.select(
        "user_id", "experience_years",
        F.to_json(F.struct(*[c for c in context.columns if c != "user_id"])).alias("context"))
    rows = attach(extraction_payload(rows), context, "user_id")
    answered = call_model(rows, fn, "payload", context="context", batch_size=batch_size,
                          parallelism=parallelism)
    return evaluate_fit(answered.withColumn("facts", parse_facts("model_json"))).drop(
        "payload", "context", "model_json")


def outcome(evaluated: DataFrame) -> DataFrame:
    """Matched and rejected counts and model usage per user."""
    return evaluated.groupBy("user_id").agg(
        F.count_if(F.col("status") == "matched").alias("matched"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        *[F.sum(n).alias(n) for n in USAGE])
