"""Row shaping: landed postings to one schema, evaluated postings to ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.fit import strings
from siftwell.functions.text import first_truthy, finite, round_half_up, strip_html, truthy


def normalize_jobs(df: DataFrame, job: str = "job", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flatten a landed posting struct to the common columns.

    Each field takes the first of its spellings that is neither null nor empty.
    """
    j = F.col(job)
    detail = lambda name: first_truthy(j[name], j["details"][name])
    return df.select(
        *keep,
        j["id"].alias("id"),
        first_truthy(j["link"], j["jobUrl"]).alias("link"),
        first_truthy(j["title"], j["position"]).alias("title"),
        first_truthy(j["companyName"], j["company"]).alias("company_name"),
        j["companyDescription"].alias("company_description"),
        j["location"].alias("location"),
        first_truthy(j["postedAt"], j["date"]).alias("posted_at"),
        j["salary"].alias("salary"),
        strip_html(first_truthy(j["descriptionText"], j["details"]["descriptionText"])).alias(
            "description_text"),
        j["applicantsCount"].alias("applicants_count"),
        j["applyUrl"].alias("apply_url"),
        detail("seniorityLevel").alias("seniority_level"),
        detail("employmentType").alias("employment_type"),
        detail("jobFunction").alias("job_function"),
        detail("industries").alias("industries"),
        j["benefits"].alias("benefits"),
        first_truthy(j["source"], default="linkedin").alias("source"),
    )


def to_ledger_rows(evaluated: DataFrame) -> DataFrame:
    """Columns of a ledger row from an evaluated posting (facts, score and skill lists attached).

    Location falls back to the extracted one only when it is null (an empty text stays); the apply
    address falls back to the posting's own when it is null or empty.
    """
    f = F.col("facts")
    return evaluated.select(
        "user_id", "ord",
        F.col("link").alias("job_link"), "fingerprint",
        F.col("title").alias("job_title"), "company_name",
        F.coalesce("location", f["job_location"]).alias("location"),
        "posted_at", "salary",
        round_half_up("score").cast("int").alias("ai_score"),
        F.col("reason").alias("ai_reason"),
        f["job_domain"].alias("job_domain"),
        finite(f["min_required_yoe"]).alias("min_required_yoe"),
        finite(f["max_required_yoe"]).alias("max_required_yoe"),
        strings(f["required_skills"]).alias("required_skills"),
        strings(f["preferred_skills"]).alias("preferred_skills"),
        strings(f["candidate_matched_required_skills"]).alias("candidate_matched_required_skills"),
        strings(f["candidate_matched_preferred_skills"]).alias("candidate_matched_preferred_skills"),
        strings("missing_required").alias("candidate_missing_required_skills"),
        strings("missing_preferred").alias("candidate_missing_preferred_skills"),
        F.coalesce(f["domain_matches_candidate"], F.lit(False)).alias("domain_matches_candidate"),
        f["job_location"].alias("ai_job_location"),
        F.coalesce(truthy(f["direct_apply"]), truthy("apply_url")).alias("direct_apply"),
        truthy("applicants_count").alias("applicants_count"),
        "source", "status",
    )


def extraction_payload(df: DataFrame) -> DataFrame:
    """Add ``payload``: the ten fields a model sees of a posting, as JSON (nulls are written)."""
    fields = F.struct(
        F.col("title").alias("title"), F.col("location").alias("location"),
        F.col("seniority_level").alias("seniorityLevel"),
        F.col("employment_type").alias("employmentType"),
        F.col("job_function").alias("jobFunction"), F.col("industries").alias("industries"),
        F.col("salary").alias("salary"),
        F.coalesce("description_text", F.lit("")).alias("descriptionText"),
        F.col("benefits").alias("benefits"), F.col("extracted_yoe_text").alias("extracted_yoe"),
    )
    return df.withColumn("payload", F.to_json(fields, {"ignoreNullFields": "false"}))


def candidate_context(users: DataFrame) -> DataFrame:
    """The candidate columns a model sees, plus what the posting rules need."""
    return users.select(
        F.col("id").alias("user_id"), "experience_years", "target_locations", "employment_type",
        "primary_domain", "candidate_summary", "known_skills", "education", "projects",
        "certifications", "key_highlights", "suggested_job_titles",
        F.ceil(F.coalesce("experience_years", F.lit(0.0))).alias("years"),
        F.when(F.size(strings("known_skills")) > 0, F.array_join("known_skills", ", "))
        .otherwise(F.lit("See resume")).alias("skills_text"),
    )
