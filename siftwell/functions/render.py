"""Message, post and document texts built as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.constants import FREE, HIGH_SCORE, LOCAL_ZONE, PREMIUM, PREMIUM_PRICE_INR, TIERS
from siftwell.functions.experience import yoe_short_label
from siftwell.functions.fit import ordered_union, strings
from siftwell.functions.links import source_label
from siftwell.functions.text import (
    col, first_truthy, html_escape, let, number_text, trim_ws, truthy, url_component,
)

ALERTS = {tier: alerts for tier, _, _, alerts in TIERS}


def _join(*parts) -> Column:
    """Concatenate; a null part counts as empty."""
    return F.concat(*[F.coalesce(p if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts])


def _line_if(value: Column, *parts) -> Column:
    """The parts when the value is neither null nor empty, else nothing."""
    return F.when(truthy(value).isNotNull(), _join(*parts)).otherwise(F.lit(""))


# --- templates ---------------------------------------------------------------

def fill_template(template, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` placeholders in one pass.

    Unknown placeholders stay as they are, and text brought in by a value is not looked at again.
    """
    template = F.coalesce(col(template), F.lit(""))
    pairs = [x for name, value in values.items()
             for x in (F.lit(name), F.coalesce(value, F.lit("")))]
    lookup = F.create_map(*pairs)
    texts = F.split(template, r"\{[0-9A-Za-z_]+\}", -1)
    names = F.regexp_extract_all(template, F.lit(r"\{([0-9A-Za-z_]+)\}"), F.lit(1))
    filled = let(lookup, lambda values: F.transform(names, lambda n: F.coalesce(
        F.try_element_at(values, n), F.concat(F.lit("{"), n, F.lit("}")))))
    pieces = F.zip_with(texts, filled, lambda t, v: F.concat(t, F.coalesce(v, F.lit(""))))
    return F.array_join(pieces, "")


def post_values(phone, default_phone: str = "") -> dict[str, Column]:
    """Placeholder values of a posting row."""
    needs = ordered_union("required_skills", "preferred_skills")
    return {
        "title": first_truthy("title", default="Software Engineer"),
        "companyName": first_truthy("company_name", default="a company"),
        "location": first_truthy("ai_job_location", "location", default="India"),
        "experience": yoe_short_label("min_required_yoe", "max_required_yoe"),
        "employmentType": first_truthy("employment_type"),
        "seniorityLevel": first_truthy("seniority_level"),
        "salary": first_truthy("salary"),
        "applyLink": first_truthy("link"),
        "directApply": first_truthy("direct_apply"),
        "skills": F.array_join(F.transform(needs, lambda s: F.concat(F.lit("- "), s)), "\n"),
        "userPhone": first_truthy(phone, default=default_phone),
    }


def default_post(phone, default_phone: str = "", header: str = "", footer: str = "") -> Column:
    """Post text when the user has no template.

    Header and footer are the deployment's own words; ``{userPhone}`` in the footer is filled in.
    """
    v = post_values(phone, default_phone)
    level = F.when(v["seniorityLevel"] != "", F.concat(F.lit("("), v["seniorityLevel"], F.lit(")")))
    label = F.concat_ws(" ", truthy(v["employmentType"]), level)
    return _join(
        header,
        v["companyName"], " is hiring for the role of ", v["title"], "\n",
        "📍 Location : ", v["location"], "\n",
        _line_if(label, "💼 Employment : ", label, "\n"),
        _line_if(v["experience"], "⏳ Experience : ", v["experience"], "\n"),
        _line_if(v["salary"], "💰 Salary : ", v["salary"], "\n"),
        _line_if(v["skills"], "\nRequirements :\n", v["skills"], "\n"),
        _line_if(v["applyLink"], "\n\n🔗 Apply link : ", v["applyLink"], "\n\n"),
        _line_if(v["directApply"], "📧 Direct Apply : ", v["directApply"], "\n\n"),
        F.replace(F.lit(footer), F.lit("{userPhone}"), v["userPhone"]),
    )


def post_text(template, phone, default_phone: str = "", header: str = "", footer: str = "") -> Column:
    """The user's own template when it is not blank, else the default post."""
    own = fill_template(template, post_values(phone, default_phone))
    blank = F.length(trim_ws(F.coalesce(col(template), F.lit("")))) == 0
    return F.when(blank, default_post(phone, default_phone, header, footer)).otherwise(own)


# --- digest --------------------------------------------------------------------

RULE = "━" * 26
CARD_RULE = "─" * 20


def local_time_text(ts) -> Column:
    """24 Jul 2026, 09:00 am IST"""
    local = F.from_utc_timestamp(col(ts), LOCAL_ZONE)
    return F.concat(F.date_format(local, "dd MMM yyyy, hh:mm "),
                    F.lower(F.date_format(local, "a")), F.lit(" IST"))


def run_summary(run_at, scraped, matched) -> Column:
    stamp = F.concat(F.lit("<b>JOB MATCH SUMMARY</b> • <code>"), local_time_text(run_at),
                     F.lit(f"</code>\n{RULE}\n📥 <b>Total Jobs Scraped:</b> <code>"),
                     col(scraped).cast("string"), F.lit("</code>\n🎯 <b>Final Matches Found:</b> "))
    none = F.concat(F.lit("🔎 "), stamp, F.lit(
        "<code>0</code>\n\n☕️ <i>No matching jobs found in this run. Check back later!</i>"))
    some = F.concat(F.lit("✨ "), stamp, F.lit("<b>"), col(matched).cast("string"), F.lit("</b>"))
    return F.when(col(matched) == 0, none).otherwise(some)


def upgrade_notice(tier, matched) -> Column:
    """Note under a digest of a free-tier user; null for others."""
    free, premium = ALERTS[FREE], ALERTS[PREMIUM]
    none = (f"💡 <b>Want more job alerts?</b>\nUpgrade to Premium to get {premium} alerts daily instead"
            f" of {free}.\nContact admin to upgrade.")
    some = (f"💡 <b>Want {premium - free} more alerts today?</b>\nYou're on the Free tier ({free} "
            f"alert/day). Upgrade to Premium at ₹{PREMIUM_PRICE_INR}/month and get {premium} job alerts"
            " daily.\nContact admin to upgrade.")
    return F.when(col(tier) == FREE, F.when(col(matched) == 0, F.lit(none)).otherwise(F.lit(some)))


def match_card(rank, app_url: str) -> Column:
    """Card text of one matched posting."""
    label = source_label("source", "link")
    score = F.coalesce(col("ai_score").cast("int"), F.lit(0))
    matched, missing = F.array_join("matched_skills", ", "), F.array_join("missing_skills", ", ")
    row_id = url_component(first_truthy("id"))
    apply_url = _join(app_url, "/redirect.html?jobId=", row_id, "&source=telegram&type=apply&target=",
                      url_component(first_truthy("link")))
    resume_url = _join(app_url, "/resume.html?id=", row_id, "&jobId=", row_id,
                       "&source=telegram&type=resume")
    show_source = truthy("source").isNotNull() | (label != "LinkedIn")
    return _join(
        "<b>[ #", col(rank).cast("string"), " ] — ", F.col("title"), f"</b>\n{CARD_RULE}\n",
        F.when(show_source, F.concat(F.lit("💼 <b>Source:</b> <code>"), label, F.lit("</code>\n"))),
        "🏢 <b>Company:</b>  <code>", F.col("company_name"), "</code>\n",
        "📍 <b>Location:</b> <code>", F.coalesce("ai_job_location", F.lit("Not specified")), "</code>\n",
        "📅 <b>Posted:</b> <code>", F.coalesce("posted_at", F.lit("Unknown")), "</code>\n",
        "⏳ <b>Experience:</b> <code>",
        yoe_short_label("min_required_yoe", "max_required_yoe", "Not specified"), "</code>\n\n",
        F.when(score >= HIGH_SCORE, "✅").otherwise("⚠️"), " <b>Match Score:</b> <code>",
        F.col("ai_score").cast("int").cast("string"), "/10</code>\n",
        _line_if(F.col("direct_apply"), "📩 <b>Direct Apply:</b> <i>", F.col("direct_apply"), "</i>\n"),
        _line_if(matched, "✅ <b>Matched Skills:</b> <i>", matched, "</i>\n\n"),
        _line_if(missing, "❌ <b>Missing Skills:</b> <i>", missing, "</i>\n\n"),
        _line_if(F.col("ai_reason"), "📝 <b>AI Reason:</b> <i>", F.col("ai_reason"), "</i>\n\n"),
        '\n🚀 <a href="', apply_url, '"><b>APPLY ON ', F.upper(label), "</b></a>\n",
        '\n📄 <a href="', resume_url, '"><b>VIEW & PRINT ATS RESUME</b></a>',
    )


# --- accounts --------------------------------------------------------------------

def _by_tier(tier, index: int) -> Column:
    out = None
    for row in TIERS:
        cond = col(tier) == row[0]
        out = F.when(cond, F.lit(row[index])) if out is None else out.when(cond, F.lit(row[index]))
    return out


def account_status() -> Column:
    """Status message of a users row."""
    alerts = _by_tier("tier", 3)
    amount = F.when(F.col("subscription_amount") > 0, F.concat(
        F.lit(" (₹"), number_text("subscription_amount"), F.lit("/month)"))).otherwise(F.lit(" (Trial)"))
    expires = F.date_format(F.from_utc_timestamp("subscription_expires_at", LOCAL_ZONE), "d/M/yyyy")
    subscription = (
        F.when(F.col("tier") == FREE,
               F.lit(f"💡 <b>Upgrade:</b> Contact admin for Premium at ₹{PREMIUM_PRICE_INR}/month\n"))
        .when(expires.isNotNull(), F.concat(F.lit("📅 <b>Expires:</b> "), expires, amount, F.lit("\n")))
    )
    return _join(
        "📊 <b>Account Status</b>\n\n👤 <b>User:</b> ", html_escape(F.coalesce(truthy("name"), "email")),
        "\n🆔 <b>ID:</b> ", F.col("id"),
        "\n🔄 <b>Status:</b> ", F.when(F.col("is_active"), "Active ✅").otherwise("Paused ⏸️"),
        "\n", _by_tier("tier", 1), " <b>Tier:</b> ", _by_tier("tier", 2), " (",
        alerts.cast("string"), " alert", F.when(alerts > 1, "s"), "/day)\n",
        subscription, "🚀 <b>Total Runs:</b> ", F.col("total_runs_count").cast("string"),
    )


def expiry_notice(amount) -> Column:
    what = F.when(col(amount) > 0, F.concat(F.lit("₹"), number_text(amount), F.lit("/month"))).otherwise(
        F.lit("Premium"))
    return F.concat(
        F.lit("⏰ <b>Subscription Expired</b>\nYour "), what,
        F.lit(f" subscription has ended. You're now on the free tier ({ALERTS[FREE]} alert/day).\n"
              "Contact admin to renew."))


# --- documents -------------------------------------------------------------------

def resume_markdown(resume, name, email) -> Column:
    """Structured resume to Markdown; sections without entries are left out."""
    r = col(resume)
    contact = F.transform(F.map_entries(r["contact_details"]),
                          lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    none = F.array().cast("array<string>")

    def section(title: str, items, lines: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.array(F.lit(f"## {title}")), lines)).otherwise(none)

    experience = F.flatten(F.transform(r["experience"], lambda e: F.concat(
        F.array(F.concat(F.lit("### "), e["title"], F.lit(" — "), e["company"], F.lit(" ("),
                         e["dates"], F.lit(")"))),
        F.transform(strings(e["bullets"]), lambda b: F.concat(F.lit("- "), b)))))
    education = F.transform(r["education"], lambda e: F.concat(
        F.lit("- "), e["degree"], F.lit(", "), e["institution"], F.lit(" ("), e["dates"], F.lit(")")))
    projects = F.flatten(F.transform(r["projects"], lambda p: F.array(
        F.concat(F.lit("### "), p["name"], F.when(
            F.size(strings(p["technologies"])) > 0,
            F.concat(F.lit(" — "), F.array_join(p["technologies"], ", "))).otherwise(F.lit(""))),
        p["description"])))
    lines = F.concat(
        F.array(
            F.concat(F.lit("# "), first_truthy(name, default="Candidate")),
            F.concat_ws(" | ", F.array(F.coalesce(col(email), F.lit(""))), contact),
            F.lit("## Summary"), F.coalesce(r["summary"], F.lit("")),
            F.lit("## Skills"), F.array_join(strings(r["skills"]), ", "),
        ),
        section("Work Experience", r["experience"], experience),
        section("Education", r["education"], education),
        section("Projects", r["projects"], projects),
    )
    return F.array_join(lines, "\n\n")
