"""Posting filters as columns: each gives a reason or flag, so both sides stay available."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.constants import (
    BLOCKED_COMPANIES, FRESHNESS_DAYS, JUNIOR_TITLE_KEYWORDS, MIN_DESCRIPTION_CHARS,
    SENIOR_CANDIDATE_ABOVE, SENIOR_TITLE_KEYWORDS,
)
from siftwell.functions.experience import extract_yoe, fresher_friendly, yoe_reject_reason
from siftwell.functions.fit import strings
from siftwell.functions.text import col, contains_any, first_contained, let, number_text, trim_ws, truthy


def company_blocked(company, blocklist=BLOCKED_COMPANIES) -> Column:
    """Company name contains a blocked name; a blank name never does."""
    name = trim_ws(F.lower(F.coalesce(col(company), F.lit(""))))
    return (name != "") & contains_any(name, [b.lower().strip() for b in blocklist])


def posting_complete(link="link", title="title", company="company_name", description="description_text",
                     min_chars: int = MIN_DESCRIPTION_CHARS) -> Column:
    """Link, title and company present and a description of at least ``min_chars`` characters."""
    present = F.lit(True)
    for c in (link, title, company):
        present = present & truthy(c).isNotNull()
    return present & (F.length(trim_ws(F.coalesce(col(description), F.lit("")))) >= min_chars)


# Written dates besides ISO forms, each with the shape it is tried on.
WRITTEN_DATES = [
    ("^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
    ("^[A-Z][a-z]{2,8} [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy"),
    ("^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}$", "d MMM yyyy"),
    ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
]


def posted_time(posted_at) -> Column:
    """The posting time, or null when missing or not a date ("2 days ago").

    A format is only tried on texts of its shape: failing parses are slow.
    """
    text = trim_ws(posted_at)
    out = F.when(text.rlike("^[0-9]{4}"), F.try_to_timestamp(text))
    for shape, pattern in WRITTEN_DATES:
        parsed = F.try_to_timestamp(text, F.lit(pattern))
        out = out.when(text.rlike(shape) & parsed.isNotNull(), parsed)
    return out


def outdated(posted_at, now: Column, days: int = FRESHNESS_DAYS) -> Column:
    """Older than ``days``; undated postings are not."""
    age = F.unix_micros(now) - F.unix_micros(posted_time(posted_at))
    return F.coalesce(age > days * 86_400_000_000, F.lit(False))


def keyword_hits(title, seniority, excludes) -> Column:
    """The candidate's exclude keywords found in title and seniority, in the candidate's order."""
    text = F.concat(F.lower(F.coalesce(col(title), F.lit(""))), F.lit(" "),
                    F.lower(F.coalesce(col(seniority), F.lit(""))))
    words = F.transform(strings(excludes), lambda k: trim_ws(F.lower(k)))
    return let(text, lambda t: F.filter(words, lambda k: (k != "") & F.contains(t, k)))


def seniority_keyword(title, candidate) -> Column:
    """First keyword, in list order, that puts the title out of the candidate's range; else null."""
    text = F.lower(F.coalesce(col(title), F.lit("")))
    return F.when(col(candidate) > SENIOR_CANDIDATE_ABOVE, first_contained(text, JUNIOR_TITLE_KEYWORDS)) \
        .otherwise(first_contained(text, SENIOR_TITLE_KEYWORDS))


def seniority_reason(keyword, candidate) -> Column:
    junior = F.when(col(candidate) > SENIOR_CANDIDATE_ABOVE, F.lit(" (junior role)")).otherwise(F.lit(""))
    return F.concat(F.lit('Seniority: "'), col(keyword), F.lit('"'), junior,
                    F.lit(" in title, candidate has "), number_text(candidate), F.lit(" YOE"))


def with_yoe(df: DataFrame, description="description_text", seniority="seniority_level") -> DataFrame:
    """Add the stated experience range and the fresher flag. Depends on the text only, so it runs
    in the scan stage and later steps need not carry the text for it."""
    text = F.concat(F.coalesce(col(description), F.lit("")), F.lit(" "),
                    F.coalesce(col(seniority), F.lit("")))
    return (
        df.withColumn("_yoe", extract_yoe(text))
        .withColumns({
            "yoe_min": F.col("_yoe.min"), "yoe_max": F.col("_yoe.max"),
            "extracted_yoe_text": F.col("_yoe.text"), "fresher": fresher_friendly(text),
        })
        .drop("_yoe")
    )


def company_block(df: DataFrame, blocklist=BLOCKED_COMPANIES) -> DataFrame:
    return df.withColumn("blocked", company_blocked("company_name", blocklist))


def valid_posting(df: DataFrame, min_chars: int = MIN_DESCRIPTION_CHARS) -> DataFrame:
    return df.filter(posting_complete(min_chars=min_chars))


def fresh(df: DataFrame, now: Column, days: int = FRESHNESS_DAYS) -> DataFrame:
    return df.filter(~outdated("posted_at", now, days))


def keyword_filter(df: DataFrame) -> DataFrame:
    """Add ``reason``: all hits joined, or null for a row that passes."""
    hits = keyword_hits("title", "seniority_level", "exclude_title_keywords")
    return df.withColumn("_hits", hits).withColumn(
        "reason", F.when(F.size("_hits") > 0, F.array_join("_hits", ", "))).drop("_hits")


def yoe_filter(df: DataFrame) -> DataFrame:
    """Add the stated range and ``reason`` (null for a row that passes)."""
    return with_yoe(df).withColumn(
        "reason", yoe_reject_reason("yoe_min", "yoe_max", "candidate_years", "fresher"))


def seniority_filter(df: DataFrame) -> DataFrame:
    """Add ``reason`` (null for a row that passes)."""
    return df.withColumn("_kw", seniority_keyword("title", "candidate_years")).withColumn(
        "reason", seniority_reason("_kw", "candidate_years")).drop("_kw")
