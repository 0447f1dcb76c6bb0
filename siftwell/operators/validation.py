"""Row validation: rules are columns that give an error text or null."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import constants as K
from siftwell.functions.text import col, trim_ws, truthy

EMAIL = r"^[A-Za-z0-9_+&*\-]+(?:\.[A-Za-z0-9_+&*\-]+)*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z$"
UUID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _text(c) -> Column:
    return trim_ws(col(c).cast("string"))


def _given(c) -> Column:
    return truthy(col(c).cast("string")).isNotNull()


# --- rule makers -----------------------------------------------------------------

def check(bad: Column, message) -> Column:
    """Error text where ``bad`` holds; an unknown condition is no error."""
    return F.when(bad, message if isinstance(message, Column) else F.lit(message))


def required_any(columns: Sequence[str], message: str) -> Column:
    missing = F.lit(True)
    for c in columns:
        missing = missing & F.coalesce(_text(c) == "", F.lit(True))
    return check(missing, message)


def one_of(c: str, allowed: Sequence, message: Callable[[Column], Column], patterns: Sequence[str] = ()) -> Column:
    value = F.lower(_text(c))
    ok = value.isin([str(a).lower() for a in allowed])
    for p in patterns:
        ok = ok | value.rlike(p)
    return check(_given(c) & ~ok, message(col(c).cast("string")))


def all_of(c: str, allowed: Sequence[str], message: Callable[[Column], Column], skip_blank: bool = False) -> Column:
    """Every item of a comma list (or array, see ``is_array``) is allowed; the first bad one is named."""
    items = F.transform(F.split(col(c), ","), trim_ws)
    return _items_rule(items, allowed, message, skip_blank, _given(c))


def all_of_array(c: str, allowed: Sequence[str], message: Callable[[Column], Column], skip_blank: bool = False) -> Column:
    return _items_rule(col(c), allowed, message, skip_blank, col(c).isNotNull())


def _items_rule(items, allowed, message, skip_blank, given) -> Column:
    names = [str(a).lower() for a in allowed]
    bad = F.filter(items, lambda i: ~F.lower(i).isin(names))
    if skip_blank:
        bad = F.filter(bad, lambda i: i != "")
    first = F.get(bad, F.lit(0))
    return check(given & first.isNotNull(), message(first))


def int_between(c: str, lo: int, hi: int | None, message: Callable[[Column], Column]) -> Column:
    number = _text(c).try_cast("double")
    ok = number.isNotNull() & (number == F.floor(number)) & (number >= lo)
    if hi is not None:
        ok = ok & (number <= hi)
    return check(_given(c) & ~F.coalesce(ok, F.lit(False)), message(col(c).cast("string")))


def number_between(c: str, lo: float, hi: float, low_message: str, high_message: str) -> Column:
    return F.coalesce(check(col(c) < lo, low_message), check(col(c) > hi, high_message))


def length_between(c: str, lo: int | None, hi: int | None, low_message: str = "", high_message: str = "",
                   trim: bool = False) -> Column:
    n = F.length(trim_ws(c) if trim else col(c))
    rules = []
    if lo is not None:
        rules.append(check(n < lo, low_message))
    if hi is not None:
        rules.append(check(n > hi, high_message))
    return F.coalesce(*rules)


def matches(c: str, pattern: str, message: str) -> Column:
    return check(~col(c).rlike(pattern), message)


def max_items(c: str, n: int, message: str) -> Column:
    return check(F.size(c) > n, message)


def present(c: str, message: str = "Required") -> Column:
    return check(col(c).isNull(), message)


def named(path: str, rule: Column) -> Column:
    """Prefix the error with the field it belongs to."""
    return F.concat(F.lit(f"{path}: "), rule)


# --- running ----------------------------------------------------------------------

def with_errors(df: DataFrame, rules: Sequence[Column], first_only: bool = False) -> DataFrame:
    """Add ``error_list`` and ``errors`` (joined by "; "; empty when valid)."""
    found = F.array_compact(F.array(*rules))
    df = df.withColumn("error_list", F.slice(found, 1, 1) if first_only else found)
    return df.withColumn("errors", F.array_join("error_list", "; "))


def validate(df: DataFrame, rules: Sequence[Column], first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their errors)."""
    checked = with_errors(df, rules, first_only)
    good = checked.filter(F.size("error_list") == 0).drop("error_list", "errors")
    return good, checked.filter(F.size("error_list") > 0).drop("error_list")


@dataclass(frozen=True)
class Default:
    """Fill-in of one request column."""

    kind: str  # int, text, flag
    value: object = None


def with_defaults(df: DataFrame, spec: dict[str, Default]) -> DataFrame:
    """Coerce request columns: trimmed text or null, integers with a default (0 counts as absent),
    flags true only for true."""
    out = {}
    for name, d in spec.items():
        if d.kind == "int":
            n = F.nullif(_text(name).try_cast("double").cast("int"), F.lit(0))
            out[name] = F.coalesce(n, F.lit(d.value)) if d.value is not None else n
        elif d.kind == "flag":
            out[name] = F.coalesce(col(name).cast("string") == "true", F.lit(False))
        else:
            text = truthy(_text(name))
            out[name] = F.coalesce(text, F.lit(d.value)) if d.value is not None else text
    return df.withColumns(out)


# --- search requests per platform ----------------------------------------------------

def _invalid(field: str, rest: str) -> Callable[[Column], Column]:
    return lambda v: F.concat(F.lit(f'Validation Error: Invalid {field} "'), v, F.lit(f'". {rest}'))


def _paging() -> list[Column]:
    return [
        int_between("limit", 1, 100, _invalid("limit", "Limit must be an integer between 1 and 100.")),
        int_between("page", 0, None, _invalid("page", "Page must be a non-negative integer.")),
    ]


KEYWORD_OR_LOCATION = 'Validation Error: Either "keyword" or "location" parameter must be provided.'


def search_rules(platform: str) -> list[Column]:
    """Checks of a search request; the first failing one is reported."""
    if platform == "linkedin":
        limit, _ = _paging()
        return [
            required_any(["keyword", "location"], KEYWORD_OR_LOCATION),
            one_of("dateSincePosted", K.DATE_POSTED_VALUES, _invalid(
                "dateSincePosted", f"Allowed values: {', '.join(K.DATE_POSTED_VALUES)}, or dynamic hours "
                'e.g. "12hr", "6hr"'), [r"^[0-9]+h(?:r|ours?)?$", r"^r[0-9]+$"]),
            all_of("jobType", K.JOB_TYPE_VALUES, _invalid(
                "jobType", "Allowed values: full time, part time, contract, temporary, volunteer, internship")),
            all_of("experienceLevel", K.EXPERIENCE_VALUES, _invalid(
                "experienceLevel",
                "Allowed values: internship, entry level, associate, senior, director, executive")),
            all_of("remoteFilter", K.REMOTE_VALUES, _invalid(
                "remoteFilter", "Allowed values: on-site, remote, hybrid")),
            one_of("sortBy", K.SORT_VALUES, _invalid("sortBy", "Allowed values: recent, relevant")),
            limit,
            int_between("page", 0, None, _invalid("page", "Page must be a non-negative integer >= 0.")),
        ]
    if platform == "naukri":
        ages = ", ".join(str(a) for a in K.JOB_AGE_VALUES)
        return [
            required_any(["keyword"], 'Validation Error: "keyword" parameter is required.'),
            int_between("experience", 0, 30, _invalid("experience", "Must be an integer between 0 and 30.")),
            one_of("jobAge", K.JOB_AGE_VALUES, _invalid("jobAge", f"Allowed values: {ages}")),
            one_of("sort", K.NAUKRI_SORT_VALUES, _invalid("sort", "Allowed values: relevance, date")),
            all_of("wfhType", K.WFH_VALUES, _invalid("wfhType", "Allowed values: office, remote, hybrid")),
            *_paging(),
        ]
    if platform == "indeed":
        return [
            required_any(["keyword", "location"], KEYWORD_OR_LOCATION),
            int_between("fromage", 1, None, _invalid("fromage", "Fromage must be a positive integer.")),
            all_of("jobType", K.INDEED_JOB_TYPES, _invalid(
                "jobType", f"Allowed values: {', '.join(K.INDEED_JOB_TYPES)}"), skip_blank=True),
            one_of("sort", K.PLAIN_SORT_VALUES, _invalid(
                "sort", f"Allowed values: {', '.join(K.PLAIN_SORT_VALUES)}")),
            *_paging(),
        ]
    if platform == "simplyhired":
        return [
            required_any(["keyword", "location"], KEYWORD_OR_LOCATION),
            one_of("datePosted", K.SIMPLYHIRED_DATES, _invalid(
                "datePosted", f"Allowed values: {', '.join(K.SIMPLYHIRED_DATES)}")),
            all_of("jobType", K.SIMPLYHIRED_JOB_TYPES, _invalid(
                "jobType", f"Allowed values: {', '.join(K.SIMPLYHIRED_JOB_TYPES)}"), skip_blank=True),
            one_of("sort", K.PLAIN_SORT_VALUES, _invalid(
                "sort", f"Allowed values: {', '.join(K.PLAIN_SORT_VALUES)}")),
            int_between("distance", 0, None, _invalid("distance", "Distance must be a non-negative integer.")),
            *_paging(),
        ]
    raise ValueError(f"unknown platform {platform}")


SEARCH_DEFAULTS = {
    "keyword": Default("text"), "location": Default("text"), "limit": Default("int", 25),
    "page": Default("int", 0), "easyApply": Default("flag"), "has_verification": Default("flag"),
    "under_10_applicants": Default("flag"),
}


def sanitize_search(df: DataFrame, platform: str) -> DataFrame:
    """A valid request as the search uses it: trimmed, defaulted, with lower-case choices."""
    spec = {"keyword": Default("text"), "location": Default("text"), "limit": Default("int", 25),
            "page": Default("int", 1 if platform == "simplyhired" else 0)}
    if platform == "linkedin":
        spec |= {f: Default("flag") for f in ("easyApply", "has_verification", "under_10_applicants")}
    out = with_defaults(df, spec)
    lower = lambda c: F.lower(_text(c))
    if platform == "naukri":
        by_date = lower("sort").isin("date", "f")
        out = out.withColumns({
            "sort": F.when(_given("sort"), F.when(by_date, "date").otherwise("relevance")),
            "wfhType": F.transform(F.split(lower("wfhType"), ","), trim_ws),
            "jobAge": truthy(_text("jobAge")).try_cast("int"),
        })
    elif platform in ("indeed", "simplyhired"):
        items = F.filter(F.transform(F.split(lower("jobType"), ","), trim_ws), lambda i: i != "")
        out = out.withColumns({"sort": truthy(lower("sort")), "jobType": F.when(_given("jobType"), items)})
    return out


# --- account requests ------------------------------------------------------------------

def run_request_rules() -> list[Column]:
    return [
        named("lookbackHours", number_between(
            "lookbackHours", 1, 168, "Lookback must be at least 1 hour",
            "Lookback cannot exceed 168 hours (7 days)")),
        named("targetUserId", matches("targetUserId", UUID, "targetUserId must be a valid UUID")),
    ]


def resume_text_rule(c: str = "resumeText", label: str = "Resume plain text") -> Column:
    return named(c, length_between(
        c, 50, 15000, f"{label} must be at least 50 characters long",
        f"{label} cannot exceed 15,000 characters"))


def user_request_rules(create: bool) -> list[Column]:
    """Checks of a create or update request; every failing field is reported."""
    sources = ["linkedin", "whatsapp", "other"]
    short = lambda c, n, m: named(c, length_between(c, None, n, high_message=m, trim=True))
    long_text = lambda c, n: short(c, n, f"Too big: expected string to have <={n} characters")
    rules = [
        named("email", matches("email", EMAIL, "Must be a valid email address")),
        named("email", length_between("email", None, 255, high_message="Email cannot exceed 255 characters")),
        short("name", 100, "Name cannot exceed 100 characters"),
        short("phone", 20, "Phone number cannot exceed 20 characters"),
        resume_text_rule(),
        short("telegramChatId", 50, "Telegram Chat ID cannot exceed 50 characters"),
        short("linkedinPostTemplate", 4000, "LinkedIn post template cannot exceed 4000 characters"),
        named("tier", check(~F.col("tier").isin(K.FREE, K.PREMIUM), "Invalid option")),
        named("subscriptionAmount", number_between(
            "subscriptionAmount", 0, 10000, "Too small: expected number to be >=0",
            "Too big: expected number to be <=10000")),
        named("subscriptionExpiresAt", matches("subscriptionExpiresAt", ISO_TIME, "Invalid ISO datetime")),
        named("experienceYears", number_between(
            "experienceYears", 0, 50, "Experience years must be 0 or greater",
            "Too big: expected number to be <=50")),
        long_text("linkedinProfileUrl", 500), long_text("targetLocations", 500),
        long_text("employmentType", 100), long_text("primaryDomain", 255),
        long_text("candidateSummary", 2000),
        named("excludeTitleKeywords", check(
            F.exists("excludeTitleKeywords", lambda k: ~F.length(trim_ws(k)).between(1, 50)),
            "Keywords must have 1 to 50 characters")),
        named("excludeTitleKeywords", max_items(
            "excludeTitleKeywords", 100, "Maximum 100 exclude keywords allowed")),
        named("source", check(~F.col("source").isin(sources), f"Source must be one of: {', '.join(sources)}")),
    ]
    if create:
        rules = [named("email", present("email")), named("resumeText", present("resumeText")), *rules]
    return rules


def subscription_rules() -> list[Column]:
    return [
        named("tier", F.coalesce(present("tier"), check(~F.col("tier").isin(K.FREE, K.PREMIUM), "Invalid option"))),
        named("subscriptionAmount", F.coalesce(present("subscriptionAmount"), number_between(
            "subscriptionAmount", 0, 10000, "Subscription amount must be 0 or greater",
            "Too big: expected number to be <=10000"))),
        named("subscriptionExpiresAt", F.coalesce(present("subscriptionExpiresAt"), matches(
            "subscriptionExpiresAt", ISO_TIME, "Must be a valid ISO 8601 datetime string"))),
    ]
