"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the web understands it: ASCII blanks plus the Unicode spaces. Java's \s and
# Spark's trim() cover fewer characters, so one explicit set is used everywhere.
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as a regex class. The range test in front of the rare characters keeps the check of
# an ordinary character short, which matters on long texts.
SPACE = (
    r"[\t-\r \u00a0[\u1680-\ufeff&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]]"
)
WORD_START = "(?<![0-9A-Za-z_])"
WORD_END = "(?![0-9A-Za-z_])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    An expression used inside the lambda of filter() or transform() is computed again for every
    element; binding it to a lambda variable first avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c) -> Column:
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def collapse_ws(c) -> Column:
    """Runs of whitespace become one blank; none at either end."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def truthy(c) -> Column:
    """The value, or null when it is null or empty."""
    return F.nullif(col(c), F.lit(""))


def first_truthy(*cols, default="") -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[truthy(c) for c in cols], F.lit(default))


def normalize_text(c) -> Column:
    return collapse_ws(F.lower(F.coalesce(col(c), F.lit(""))))


def fingerprint(title, company, description) -> Column:
    """Content key of a posting: sha-256 over the three normalised texts."""
    parts = [normalize_text(c) for c in (title, company, description)]
    # coalesce tells the optimizer the key is never null; a join on it then needs no second hash of
    # the text for a null check
    return F.coalesce(F.sha2(F.concat_ws("|", *parts), 256), F.lit(""))


# (pattern, replacement) in the order they apply. "&amp;" is decoded before "&lt;" on purpose.
HTML_BREAKS = [(r"(?i)<br\s*/?>", "\n"), ("(?i)</p>", "\n\n"), ("(?i)</li>", "\n"), ("<[^>]+>", "")]
HTML_ENTITIES = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"),
]


def strip_html(c) -> Column:
    """Markup to plain text; null becomes the empty string."""
    out = F.coalesce(col(c), F.lit(""))
    for pattern, replacement in HTML_BREAKS:
        out = F.regexp_replace(out, pattern, replacement)
    for entity, replacement in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(replacement))
    out = F.regexp_replace(out, f"\n{SPACE}*\n{SPACE}*\n", "\n\n")
    return trim_ws(out)


def html_escape(c) -> Column:
    out = col(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def truncate(c, n: int) -> Column:
    return F.substring(col(c), 1, n)


def number_text(c) -> Column:
    """A double without a trailing ``.0``: 5 for 5.0, 2.5 for 2.5."""
    value = col(c).cast("double")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def finite(c) -> Column:
    """Null for NaN and the infinities."""
    value = col(c).cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def round_half_up(c) -> Column:
    """Ties go up, also below zero (-2.5 becomes -2)."""
    return F.floor(finite(c) + F.lit(0.5))


def contains_any(text: Column, words) -> Column:
    """True when the text contains one of a short literal list."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def first_contained(text: Column, words) -> Column:
    """The first word of the literal list found in the text, in list order, else null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])


def url_component(c) -> Column:
    """Percent-encode one URL component (blank is %20; - _ . ! ~ * ' ( ) stay)."""
    out = F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def slug(c) -> Column:
    return F.regexp_replace(F.lower(col(c)), f"{SPACE}+", "-")


def digits_only(c) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")
