"""Skill matching with equivalent skills and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.constants import PREFERRED_SKILL_GROUPS, SKILL_GROUPS, SKILL_LINEAGE
from siftwell.functions.fit import normalize_skill, strings
from siftwell.functions.text import SPACE, col, let


def implied_skills(groups=SKILL_GROUPS, lineage=SKILL_LINEAGE, extra_groups=None) -> dict[str, list[str]]:
    """What having a skill amounts to: itself, its group, and what it is built on."""
    out: dict[str, list[str]] = {}
    for members in [*groups.values(), *(extra_groups or {}).values()]:
        for m in members:
            out.setdefault(m, []).extend(x for x in members if x != m)
    for skill, base in lineage.items():
        out.setdefault(skill, []).extend(base)
    return {skill: list(dict.fromkeys(more)) for skill, more in out.items()}


def expand_skills(known, implied: dict[str, list[str]]) -> Column:
    """Normalised candidate skills plus everything they imply (one step).

    The rule table is a literal map inside the plan, so no join or explode is needed.
    """
    pairs = [x for skill, more in implied.items()
             for x in (F.lit(skill), F.array(*[F.lit(m) for m in more]))]
    rules = F.create_map(*pairs)
    own = F.transform(strings(known), normalize_skill)
    more = F.flatten(F.transform(own, lambda s: F.coalesce(
        F.try_element_at(rules, s), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(own, more))


def matched_skills(wanted, expanded) -> Column:
    """Wanted skills the candidate has, in the posting's spelling and order."""
    return let(col(expanded), lambda e: F.filter(
        strings(wanted), lambda s: F.array_contains(e, normalize_skill(s))))


def match_skills(df: DataFrame, known="known_skills", required="required_skills",
                 preferred="preferred_skills") -> DataFrame:
    """Add the matched lists; UI frameworks stand in for each other among preferred skills only."""
    strict = implied_skills()
    loose = implied_skills(extra_groups=PREFERRED_SKILL_GROUPS)
    return (
        df.withColumns({"_strict": expand_skills(known, strict), "_loose": expand_skills(known, loose)})
        .withColumns({
            "candidate_matched_required_skills": matched_skills(required, "_strict"),
            "candidate_matched_preferred_skills": matched_skills(preferred, "_loose"),
        })
        .drop("_strict", "_loose")
    )


def known_skill_names() -> list[str]:
    names = [m for g in [*SKILL_GROUPS.values(), *PREFERRED_SKILL_GROUPS.values()] for m in g]
    for skill, base in SKILL_LINEAGE.items():
        names += [skill, *base]
    return list(dict.fromkeys(names))


def mention_skills(df: DataFrame, text: str, name: str, dictionary: list[str] | None = None) -> DataFrame:
    """Add the dictionary skills that occur in the text as whole words, in dictionary order.

    The cleaned text is its own column, so it is made once and not once per dictionary word.
    """
    words = dictionary or known_skill_names()
    between = f"(?:{SPACE}|[,;:()!?]|[.](?=$|{SPACE}))+"
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), between, " "),
                     F.lit(" "))
    hits = F.array(*[F.when(F.contains("_plain", F.lit(f" {w} ")), F.lit(w)) for w in words])
    return df.withColumn("_plain", plain).withColumn(name, F.array_compact(hits)).drop("_plain")
