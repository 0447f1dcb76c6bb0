"""Years of experience: extraction from text, labels, rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import SPACE, WORD_END, WORD_START, col, number_text

# One mention: optional "up to", a number, optional "+" or range end, then year(s), also written
# year's. The "up to" part is case-sensitive, "year" is not. Every alternative begins with a test of
# one character, so that the scan over a long text stays cheap.
_NOT_IN_WORD = "(?<![0-9A-Za-z_].)"  # the character just read does not continue a word
MENTION = (
    f"(?=[u0-9])((?:u{_NOT_IN_WORD}p{SPACE}+to{SPACE}*)?)([0-9]+)"
    f"(?:{SPACE}*\\+|{SPACE}*[–\\-]{SPACE}*([0-9]+))?{SPACE}*[yY](?i:ear(?:'?s)?){WORD_END}"
)
POSSESSIVE = f"(?i){WORD_START}year'?s{WORD_END}"
BARE = f"(?i)^.*years?{WORD_END}"
FRESHER = f"[fF]{_NOT_IN_WORD}(?i:reshers?|resh[ -]?graduat(?:es?|ion)){WORD_END}"
UP_TO_REACH = 15  # characters before the number in which "up to" is looked for


def extract_yoe(c) -> Column:
    """Struct(min, max, text) over every mention in the text.

    min is the largest lower bound, max the largest upper bound (so min may exceed max); plain and
    "+" mentions bound from below only, "up to" from above only; a range end of 0 is ignored. text
    is the last mention, except that an "up to" one is taken only when it raises max.
    """
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(MENTION), F.lit(0))

    def shown(text: Column) -> Column:
        """years and year's read as year."""
        return F.regexp_extract(F.regexp_replace(text, POSSESSIVE, "year"), BARE, 0)

    def parse(mention: Column) -> Column:
        group = lambda i: F.regexp_extract(mention, MENTION, i)
        prefix, first = group(1), group(2).try_cast("double")
        second = F.nullif(group(3).try_cast("double"), F.lit(0.0))
        upper = (F.length(prefix) > 0) & (F.length(prefix) <= UP_TO_REACH)
        return F.struct(
            upper.alias("upper"),
            F.when(~upper, F.least(first, second)).alias("lo"),
            F.when(upper, first).when(second.isNotNull(), F.greatest(first, second)).alias("hi"),
            shown(F.substring(mention, F.length(prefix) + 1, F.length(mention))).alias("text"),
        )

    def fold(acc: Column, m: Column) -> Column:
        raises = acc["max"].isNull() | (m["hi"] > acc["max"])
        return F.struct(
            F.greatest(acc["min"], m["lo"]).alias("min"),
            F.greatest(acc["max"], m["hi"]).alias("max"),
            F.when(m["upper"] & ~raises, acc["text"]).otherwise(m["text"]).alias("text"),
        )

    empty = F.struct(
        F.lit(None).cast("double").alias("min"),
        F.lit(None).cast("double").alias("max"),
        F.lit(None).cast("string").alias("text"),
    )
    return F.aggregate(F.transform(found, parse), empty, fold)


def fresher_friendly(c) -> Column:
    return col(c).rlike(FRESHER)


def candidate_years(c) -> Column:
    """Whole years of a candidate, rounded up; unknown counts as 0."""
    return F.ceil(F.coalesce(col(c), F.lit(0.0)))


def yoe_reject_reason(lo, hi, candidate, fresher) -> Column:
    """Why the stated range excludes the candidate; null when it does not."""
    lo, hi, candidate, fresher = col(lo), col(hi), col(candidate), col(fresher)
    have = F.concat(F.lit(" yr, candidate has "), number_text(candidate), F.lit(" yr"))
    have_max = F.concat(F.lit("- yr max, candidate has "), number_text(candidate), F.lit(" yr"))
    requires = F.lit("YOE: requires ")
    return F.when(lo > candidate, F.concat(requires, number_text(lo), F.lit("+"), have)).when(
        (hi < candidate) & ~fresher, F.concat(requires, number_text(hi), have_max))


def yoe_label(lo, hi) -> Column:
    lo_t, hi_t = number_text(lo), number_text(hi)
    return (
        F.when(col(lo).isNotNull() & col(hi).isNotNull(),
               F.concat(lo_t, F.lit("-"), hi_t, F.lit(" years")))
        .when(col(lo).isNotNull(), F.concat(lo_t, F.lit("+ years")))
        .when(col(hi).isNotNull(), F.concat(F.lit("0-"), hi_t, F.lit(" years")))
        .otherwise(F.lit("Not specified"))
    )


def yoe_short_label(lo, hi, unknown: str = "") -> Column:
    return (
        F.when(col(lo).isNotNull() & col(hi).isNotNull(),
               F.concat(number_text(lo), F.lit("-"), number_text(hi), F.lit(" YOE")))
        .when(col(lo).isNotNull(), F.concat(number_text(lo), F.lit(" YOE")))
        .otherwise(F.lit(unknown))
    )
