"""URLs, sources, regions, look-back windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.constants import INDIAN_PLACES, NAMED_LOOKBACKS
from siftwell.functions.text import col, let, trim_ws, truthy

CANONICAL_VIEW = "https://www.linkedin.com/jobs/view/"
# scheme, optional user info, host, optional port, path
URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)"
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def normalize_link(c) -> Column:
    """Canonical posting link.

    A numeric id after ``/view/`` or in ``currentJobId`` gives the canonical view URL; any other
    URL loses query and fragment; text that is not a URL is returned unchanged.
    """
    link = trim_ws(c)
    part = lambda i: F.regexp_extract(link, URL, i)
    path = part(4)
    query = F.regexp_extract(link, r"^[^?#]*\?([^#]*)", 1)
    url = F.struct(
        F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("host"), part(3).alias("port"),
        F.when(path == "", "/").otherwise(path).alias("path"), query.alias("query"))

    def canonical(u: Column) -> Column:
        param = F.regexp_extract(u["query"], r"(?:^|&)currentJobId=([^&]*)", 1)
        posting_id = F.coalesce(
            truthy(F.regexp_extract(u["path"], r"/view/([0-9]+)", 1)),
            truthy(F.coalesce(F.try_url_decode(param), param)))
        default_port = F.lit(False)
        for name, number in DEFAULT_PORTS.items():
            default_port = default_port | ((u["scheme"] == name) & (u["port"] == number))
        port = F.when((u["port"] == "") | default_port, "").otherwise(F.concat(F.lit(":"), u["port"]))
        return (
            F.when(u["host"] == "", col(c))  # not a URL
            .when(posting_id.isNotNull(), F.concat(F.lit(CANONICAL_VIEW), posting_id))
            .otherwise(F.concat(u["scheme"], F.lit("://"), u["host"], port, u["path"]))
        )

    return let(url, canonical)


def source_label(source, link) -> Column:
    """Display name of the site a posting came from."""
    name, url = F.lower(F.coalesce(col(source), F.lit(""))), F.coalesce(col(link), F.lit(""))
    return (
        F.when((name == "naukri") | F.contains(url, F.lit("naukri.com")), F.lit("Naukri"))
        .when((name == "simplyhired") | F.contains(url, F.lit("simplyhired.")), F.lit("SimplyHired"))
        .when((name == "indeed") | F.contains(url, F.lit("indeed.")), F.lit("Indeed"))
        .otherwise(F.lit("LinkedIn"))
    )


def region_of(location, platform: str = "simplyhired") -> Column:
    """Site address to use for a location."""
    if platform == "indeed":
        local, other, places = "https://in.indeed.com", "https://www.indeed.com", "india"
    else:
        local, other = "https://www.simplyhired.co.in", "https://www.simplyhired.com"
        places = INDIAN_PLACES
    return F.when(col(location).rlike(f"(?i){places}"), F.lit(local)).otherwise(F.lit(other))


def lookback_days(hours) -> Column:
    """Whole days covering a number of hours, at least one."""
    return F.greatest(F.lit(1), F.ceil(col(hours) / 24))


def lookback_code(c) -> Column:
    """Look-back text to a seconds code: 12hr -> r43200, named ranges, r<n> kept, else empty."""
    text = F.lower(trim_ws(F.coalesce(col(c), F.lit(""))))
    hours = F.regexp_extract(text, r"^([0-9]+)h(?:r|ours?)?$", 1).try_cast("bigint")
    out = F.when(text.rlike(r"^r[0-9]+$"), text).when(
        hours.isNotNull(), F.concat(F.lit("r"), (hours * 3600).cast("string")))
    for name, code in NAMED_LOOKBACKS.items():
        out = out.when(text == name, F.lit(code))
    return out.otherwise(F.lit(""))
