"""Deterministic fit rules over extracted facts and a candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.constants import (
    CATEGORY_SCORES, MATCHED_CATEGORIES, MINOR_COVERAGE, PREFERRED_BONUS_COVERAGE, STRONG_COVERAGE,
)
from siftwell.functions.experience import candidate_years, yoe_label
from siftwell.functions.text import col, collapse_ws, let, number_text, trim_ws

NO_SKILLS_DOMAIN_MATCH = (
    "No explicit skills listed; domain matches but skill extraction unavailable — not sent."
)
NO_SKILLS_DOMAIN_MISMATCH = "No explicit skills listed and domain does not match candidate."


def strings(c) -> Column:
    """The array, or an empty one for null."""
    return F.coalesce(col(c), F.array().cast("array<string>"))


def normalize_skill(c: Column) -> Column:
    return collapse_ws(trim_ws(F.lower(c)))


def skills_missing(target, matched) -> Column:
    """Target skills not among the matched ones; order and repeats of the target stay."""
    have = F.transform(strings(matched), normalize_skill)
    return let(have, lambda h: F.filter(
        strings(target), lambda t: ~F.array_contains(h, normalize_skill(t))))


def ordered_union(a, b) -> Column:
    return F.array_distinct(F.concat(strings(a), strings(b)))


def category_score(category) -> Column:
    score = None
    for name, value in CATEGORY_SCORES.items():
        cond = col(category) == name
        score = F.when(cond, F.lit(value)) if score is None else score.when(cond, F.lit(value))
    return score


def skills_reason(n_matched, missing, total, kind: str, full: bool) -> Column:
    head = F.concat(
        n_matched.cast("string"), F.lit("/"), total.cast("string"), F.lit(f" {kind} skills matched"))
    if full:
        return F.concat(head, F.lit("."))
    tail = F.when(F.size(missing) > 0,
                  F.concat(F.lit("; missing: "), F.array_join(missing, ", "), F.lit(".")))
    return F.concat(head, F.coalesce(tail, F.lit(".")))


def fit_case(facts: Column, experience) -> Column:
    """Which rule decides. Gates in order: lower bound, upper bound, no skills, required, preferred."""
    years = candidate_years(experience)
    n = lambda name: F.size(strings(facts[name]))
    required, preferred = n("required_skills"), n("preferred_skills")
    got_required = n("candidate_matched_required_skills")
    got_preferred = n("candidate_matched_preferred_skills")
    coverage = F.try_divide(got_required.cast("double"), required)
    bonus = F.try_divide(got_preferred.cast("double"), preferred)
    return (
        F.when(years < facts["min_required_yoe"], "experience_mismatch")
        .when(years > facts["max_required_yoe"], "experience_mismatch")
        .when((required == 0) & (preferred == 0) & facts["domain_matches_candidate"], "no_skills_domain_match")
        .when((required == 0) & (preferred == 0), "no_skills_domain_mismatch")
        .when((required > 0) & (coverage >= STRONG_COVERAGE), "required_strong")
        .when((required > 0) & (coverage < MINOR_COVERAGE), "required_mismatch")
        .when((required > 0) & (bonus >= PREFERRED_BONUS_COVERAGE), "required_bonus")
        .when(required > 0, "required_minor")
        .when(bonus >= STRONG_COVERAGE, "preferred_strong")
        .when(bonus >= MINOR_COVERAGE, "preferred_minor")
        .otherwise("preferred_no_match")
    )


CASE_CATEGORY = {
    "experience_mismatch": "experience_mismatch",
    "no_skills_domain_match": "no_match",
    "no_skills_domain_mismatch": "no_match",
    "required_strong": "strong_match",
    "required_bonus": "strong_match",
    "required_minor": "minor_gaps",
    "required_mismatch": "skills_mismatch",
    "preferred_strong": "strong_match",
    "preferred_minor": "minor_gaps",
    "preferred_no_match": "no_match",
}


def evaluate_fit(df, facts: str = "facts", experience: str = "experience_years"):
    """Add category, score, reason, status and the matched/missing skill lists.

    Works on columns only: no shuffle and no Python, so it fuses with the surrounding stage.
    Coverage uses the claimed matched lists as they are, so it may exceed 1. Preferred-only
    reasons count the (emptied) required lists and therefore always start with 0.
    """
    f = F.col(facts)
    df = df.withColumn("fit_case", fit_case(f, experience))
    case = F.col("fit_case")

    category = None
    for name, value in CASE_CATEGORY.items():
        category = (F.when(case == name, value) if category is None else category.when(case == name, value))

    required, preferred = strings(f["required_skills"]), strings(f["preferred_skills"])
    got_required = strings(f["candidate_matched_required_skills"])
    got_preferred = strings(f["candidate_matched_preferred_skills"])
    none = F.array().cast("array<string>")
    no_skills = case.startswith("no_skills")
    preferred_only = case.startswith("preferred")
    label = yoe_label(f["min_required_yoe"], f["max_required_yoe"])

    df = df.withColumns({
        "category": category,
        "matched_required": F.when(no_skills | preferred_only, none).otherwise(got_required),
        "matched_preferred": F.when(no_skills, none).otherwise(got_preferred),
        "missing_required": F.when(no_skills | preferred_only, none).otherwise(
            skills_missing(required, got_required)),
        "missing_preferred": F.when(no_skills, none).otherwise(skills_missing(preferred, got_preferred)),
        "years_of_experience": label,
        # shown skill lists use the claimed lists, whatever the case
        "matched_skills": ordered_union(got_required, got_preferred),
    })
    n_required, n_preferred = F.size(required), F.size(preferred)
    reason_required = lambda full: skills_reason(
        F.size("matched_required"), F.col("missing_required"), n_required, "required", full)
    reason_preferred = lambda full: skills_reason(
        F.size("matched_required"), F.col("missing_required"), n_preferred, "preferred", full)
    reason = (
        F.when(case == "experience_mismatch", F.concat(
            F.lit("Candidate has "), number_text(candidate_years(experience)),
            F.lit(" YOE; job requires "), F.col("years_of_experience"), F.lit(".")))
        .when(case == "no_skills_domain_match", F.lit(NO_SKILLS_DOMAIN_MATCH))
        .when(case == "no_skills_domain_mismatch", F.lit(NO_SKILLS_DOMAIN_MISMATCH))
        .when(case == "required_strong", reason_required(True))
        .when(case == "required_bonus", F.concat(
            reason_required(False), F.lit(" Preferred skills also strongly matched ("),
            F.size("matched_preferred").cast("string"), F.lit("/"), n_preferred.cast("string"), F.lit(").")))
        .when(case.startswith("required"), reason_required(False))
        .when(case == "preferred_strong", reason_preferred(True))
        .otherwise(reason_preferred(False))
    )
    return df.withColumns({
        "score": category_score("category"),
        "reason": reason,
        "status": F.when(F.col("category").isin(MATCHED_CATEGORIES), "matched").otherwise("rejected"),
        "missing_skills": ordered_union("missing_required", "missing_preferred"),
    })
