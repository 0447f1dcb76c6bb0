"""Stored web pages: embedded JSON, result cards, criteria, blocked pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.constants import BLOCKED_TITLE_WORDS, BLOCKED_URL_WORDS
from siftwell.functions.fit import strings
from siftwell.functions.text import col, collapse_ws, contains_any, first_truthy, let, strip_html, trim_ws, truthy
from siftwell.schemas import EMBEDDED_PAGE
from siftwell.sources.markup import Card, extract


# --- markup helpers ------------------------------------------------------------------

# Decoded once, "&amp;" last, as a browser does; strip_html keeps its own order for descriptions.
TEXT_ENTITIES = [
    ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"),
    ("&#x27;", "'"), ("&amp;", "&"),
]


def inner_text(html: Column) -> Column:
    """Text of a fragment: tags dropped without a break, entities decoded, trimmed."""
    out = F.regexp_replace(html, "<[^>]+>", "")
    for entity, char in TEXT_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return trim_ws(out)


def _tag_with_class(name: str) -> str:
    return rf'(?is)<([a-z][a-z0-9]*)\b[^>]*\bclass="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</\1>'


def text_of_class(html, *names: str) -> Column:
    """Text of the first element carrying one of the classes (classes tried in order)."""
    found = [truthy(inner_text(F.regexp_extract(col(html), _tag_with_class(n), 2))) for n in names]
    return F.coalesce(*found, F.lit(""))


def attribute_of_class(html, name: str, attribute: str) -> Column:
    """Attribute of the first tag carrying the class, whichever order they are written in."""
    tag = F.regexp_extract(
        col(html), rf'(?is)<[a-z][^>]*\bclass="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>', 0)
    return F.regexp_extract(tag, rf'(?is)\b{attribute}="([^"]*)"', 1)


def attribute_of_tag(html, tag: str, attribute: str) -> Column:
    return F.regexp_extract(col(html), rf'(?is)<{tag}\b[^>]*\b{attribute}="([^"]*)"', 1)


# --- result cards ------------------------------------------------------------------------

LIST_ITEM = r"(?is)<li\b[^>]*>.*?</li>"


def explode_cards(pages: DataFrame, pattern: str = LIST_ITEM, keep=("page_id",)) -> DataFrame:
    """One row per card (default: list item) with its position and markup."""
    cards = F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    return pages.select(*keep, F.posexplode(cards).alias("pos", "card"))


FIELDS = ["id", "position", "company", "location", "date", "salary", "jobUrl", "agoTime"]


def linkedin_card(card: Card) -> dict[str, str]:
    url = card.attribute("href", ".base-card__full-link")
    numbers = [re.search(p, url) for p in (r"view/([0-9]+)", r"([0-9]{9,12})")]
    return {
        "id": card.root.attributes.get("data-entity-urn") or next((m[1] for m in numbers if m), ""),
        "position": card.text(".base-search-card__title"),
        "company": card.text(".base-search-card__subtitle"),
        "location": card.text(".job-search-card__location"),
        "date": card.attribute("datetime", "time"),
        "salary": " ".join(card.text(".job-search-card__salary-info").split()) or "Not specified",
        "jobUrl": url,
        "agoTime": card.text(".job-search-card__listdate"),
    }


def naukri_card(card: Card) -> dict[str, str]:
    href = card.attribute("href", ".title")
    # the company is the first link of the details block, or the one marked as company name
    company = ".comp-dtls-wrap a", "a.comp-name"
    return {
        "id": "", "position": card.text(".title", "a.row1"),
        "company": card.attribute("title", *company) or card.text(*company),
        "location": card.text(".locWdth"), "date": "",
        "salary": card.text(".sal-wrap span", ".sal") or "Not specified",
        "jobUrl": href if href.startswith("https://") else f"https://www.naukri.com{href}",
        "agoTime": card.text(".job-post-day"),
    }


def indeed_card(card: Card) -> dict[str, str]:
    return {
        "id": card.attribute("data-jk", "a[data-jk]") or re.sub("^job_", "", card.attribute("id", ".jcs-JobTitle")),
        "position": card.text(".jobTitle", ".jcs-JobTitle"),
        "company": card.text("[data-testid=company-name]", ".companyName"),
        "location": card.text("[data-testid=text-location]", ".companyLocation"), "date": "",
        "salary": card.text(".salary-snippet-container") or "Not specified",
        "jobUrl": card.attribute("href", ".jcs-JobTitle"),
        "agoTime": card.text(".date"),
    }


CARD_SITES = {
    "linkedin": (("li",), linkedin_card),
    "naukri": ((".srp-jobtuple-wrapper",), naukri_card),
    "indeed": ((".cardOutline", ".job_seen_beacon"), indeed_card),
}


def pages_to_items(pages: DataFrame, site: str = "linkedin", keep=("page_id",)) -> DataFrame:
    """Result pages to posting rows; only cards with a title and a company count (Indeed's: with a key).

    Cards may hold further tags of their own name. One page fans out inside its own task; nothing is shuffled.
    """
    selectors, read = CARD_SITES[site]
    rows = extract(pages, selectors, read, FIELDS, tuple(keep)).withColumn("source", F.lit(site))
    if site == "indeed":  # these cards count by their key, complete or not
        return rows.filter(F.col("id") != "")
    return rows.filter((F.col("position") != "") & (F.col("company") != ""))


def list_items(pages: DataFrame, keep=("page_id",)) -> DataFrame:
    """Plain list items: text (whitespace collapsed) and link target; items without text are left out."""
    cards = explode_cards(pages, keep=keep)
    return cards.select(
        *keep, "pos", collapse_ws(inner_text(F.col("card"))).alias("text"),
        attribute_of_tag("card", "a", "href").alias("href"),
    ).filter(F.col("text") != "")


# --- criteria ------------------------------------------------------------------------------

def last_wins_map(entries: Column) -> Column:
    """Map from (key, value) entries; of repeated keys the last one counts."""
    entries = F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != ""))

    def keep_last(all_entries: Column) -> Column:
        later = lambda i: F.slice(all_entries, i + 2, F.size(all_entries) + 1)
        return F.filter(all_entries, lambda e, i: ~F.exists(later(i), lambda x: x["key"] == e["key"]))

    return F.map_from_entries(let(entries, keep_last))


def criteria_map(html, item: str, label: str, value: str, strip_colon: bool = False) -> Column:
    """Label -> value pairs of a detail page. The three patterns have one group each."""
    blocks = F.regexp_extract_all(col(html), F.lit(item), F.lit(1))
    key = lambda b: inner_text(F.regexp_extract(b, label, 1))
    clean = (lambda k: F.regexp_replace(k, ":$", "")) if strip_colon else (lambda k: k)
    return last_wins_map(F.transform(blocks, lambda b: F.struct(
        clean(key(b)).alias("key"), inner_text(F.regexp_extract(b, value, 1)).alias("value"))))


CRITERIA_ITEM = r'(?is)<li\b[^>]*class="(?:[^"]*\s)?description__job-criteria-item(?:\s[^"]*)?"[^>]*>(.*?)</li>'
CRITERIA_LABEL = r'(?is)class="(?:[^"]*\s)?description__job-criteria-subheader(?:\s[^"]*)?"[^>]*>(.*?)</'
CRITERIA_VALUE = r'(?is)class="(?:[^"]*\s)?description__job-criteria-text(?:\s[^"]*)?"[^>]*>(.*?)</'


def page_criteria(pages: DataFrame, item: str = CRITERIA_ITEM, label: str = CRITERIA_LABEL,
                  value: str = CRITERIA_VALUE, names: dict[str, str] | None = None,
                  strip_colon: bool = False) -> DataFrame:
    """Add ``criteria`` and the named keys as columns, '' where the page has none."""
    names = names or {
        "seniority_level": "Seniority level", "employment_type": "Employment type",
        "job_function": "Job function", "industries": "Industries",
    }
    out = pages.withColumn("criteria", criteria_map("html", item, label, value, strip_colon))
    return out.withColumns({
        c: F.coalesce(F.try_element_at("criteria", F.lit(k)), F.lit("")) for c, k in names.items()})


def page_details(pages: DataFrame) -> DataFrame:
    """Detail pages: description, applicant caption and criteria."""
    return page_criteria(pages).withColumns({
        "description_text": text_of_class("html", "show-more-less-html__markup"),
        "applicants_count": text_of_class("html", "num-applicants__caption", "sub-nav-cta__sub-title"),
    })


# --- embedded JSON ---------------------------------------------------------------------------

def embedded_json(html, script_id: str, schema) -> Column:
    """JSON of a script tag as a struct; no tag or broken JSON gives null."""
    text = F.regexp_extract(col(html), rf'<script id="{script_id}"[^>]*>(.*?)</script>', 1)
    return F.from_json(truthy(text), schema, {"mode": "PERMISSIVE"})


def salary_text(raw, detail_raw) -> Column:
    """Salary as text: a plain text as it is, else the object's raw text, the detail's, or a note."""
    is_object = F.startswith(trim_ws(col(raw)), F.lit("{"))
    return F.coalesce(
        F.when(~is_object, col(raw)), truthy(F.get_json_object(col(raw), "$.raw")), truthy(detail_raw),
        F.lit("Not specified"))


def pages_embedded_json(pages: DataFrame, base_url: Column, script_id: str = "__NEXT_DATA__",
                        schema=EMBEDDED_PAGE, keep=("page_id",)) -> DataFrame:
    """Postings of pages that embed their results as JSON; details belong to the first one only."""
    data = pages.select(*keep, "html", base_url.alias("_base")).withColumn(
        "_page", embedded_json("html", script_id, schema)["props"]["pageProps"])
    rows = data.select(
        *keep, "_base", F.col("_page.pageCursors").alias("page_cursors"),
        F.col("_page.viewJobData").alias("_first"), F.posexplode("_page.jobs").alias("pos", "j"))
    rows = rows.withColumn("_v", F.when(F.col("pos") == 0, F.col("_first"))).drop("_first")
    url = F.when(truthy("j.encodedUrl").isNotNull(), F.concat("_base", F.coalesce(
        F.try_url_decode(F.replace("j.encodedUrl", F.lit("+"), F.lit("%2B"))), "j.encodedUrl")))
    return rows.select(
        *keep, "pos", "page_cursors",
        F.col("j.jobKey").alias("id"), F.col("j.title").alias("position"),
        first_truthy(F.coalesce("_v.employerName", "j.company")).alias("company"),
        F.coalesce(truthy("_v.formattedLocation"), truthy("j.location"), F.lit("")).alias("location"),
        first_truthy("_v.datePublished", "j.dateOnIndeed").alias("date"),
        salary_text("j.salaryInfo", "_v.compensation.raw").alias("salary"),
        F.coalesce(url, F.lit("")).alias("jobUrl"),
        first_truthy("j.dateOnIndeed").alias("agoTime"),
        F.when(F.col("_v").isNotNull(), F.struct(
            strip_html("_v.jobDescriptionHtml").alias("descriptionText"),
            F.array_join(strings("_v.jobTypes"), ", ").alias("employmentType"))).alias("details"),
        F.lit("simplyhired").alias("source"),
    )


# --- blocked pages ---------------------------------------------------------------------------

def page_title(html) -> Column:
    return inner_text(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_blocked(html="html", url="url", title_words=BLOCKED_TITLE_WORDS, url_words=BLOCKED_URL_WORDS) -> Column:
    """The page is a bot check, judged by its title or (where given) its address."""
    hit = contains_any(F.lower(page_title(html)), title_words)
    if url is not None:
        hit = hit | contains_any(F.lower(F.coalesce(col(url), F.lit(""))), url_words)
    return hit


def drop_blocked_pages(pages: DataFrame, **words) -> DataFrame:
    return pages.filter(~page_blocked(**words))
