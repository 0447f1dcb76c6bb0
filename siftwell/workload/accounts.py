"""Users: subscriptions, change feed, identifiers, validation, texts."""

from pyspark.sql import functions as F

from siftwell import constants as K
from siftwell.functions.render import account_status as status_text, resume_markdown as to_markdown, run_summary
from siftwell.operators import users as U
from siftwell.operators.normalize import candidate_context
from siftwell.operators.ledger import hex_id
from siftwell.operators.validation import (
    SEARCH_DEFAULTS, run_request_rules, search_rules, subscription_rules, user_request_rules, validate, with_defaults, with_errors,
)
from siftwell.schemas import RESUME
from siftwell.workload import query
from siftwell.workload import inputs as I

EXPIRES_SQL = "CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(c_custkey % 60 AS INTEGER) END"


def _subscribers(spark, sf):
    days = (F.col("c_custkey") % 60).cast("int")
    expires = F.date_add(F.lit("2024-01-01").cast("date"), days).cast("timestamp")
    base = I.users(spark, sf).withColumn("c_custkey", F.col("id").cast("bigint"))
    return base.withColumns({
        "subscription_expires_at": F.when(F.col("c_custkey") % 4 != 0, expires),
        "updated_at": F.lit(None).cast("timestamp")}).drop("c_custkey")


SUBSCRIBERS_SQL = f"""subs AS (SELECT *, {EXPIRES_SQL} AS expires FROM users),
hit AS (SELECT * FROM subs WHERE tier = 'premium' AND expires < TIMESTAMP '{I.NOW}' AND is_active)"""


@query(I.with_(I.USERS_SQL, SUBSCRIBERS_SQL) + """
SELECT id, '⏰ <b>Subscription Expired</b>' || chr(10) || 'Your ' || CASE WHEN subscription_amount > 0 THEN '₹' ||
  CASE WHEN subscription_amount = floor(subscription_amount) THEN CAST(CAST(subscription_amount AS BIGINT) AS VARCHAR)
    ELSE CAST(subscription_amount AS VARCHAR) END || '/month' ELSE 'Premium' END
  || ' subscription has ended. You''re now on the free tier (1 alert/day).' || chr(10) || 'Contact admin to renew.' AS notice
FROM hit""")
def expired_downgrade(spark, sf):
    return U.downgrade_expired(_subscribers(spark, sf), I.now())[1].select("id", "notice")


@query(I.with_(I.USERS_SQL, SUBSCRIBERS_SQL) + """
SELECT s.id, CASE WHEN h.id IS NOT NULL THEN 'free' ELSE s.tier END AS tier,
  CASE WHEN h.id IS NULL THEN strftime(s.expires, '%Y-%m-%d') END AS expires
FROM subs s LEFT JOIN hit h ON h.id = s.id""")
def users_after_downgrade(spark, sf):
    after, _ = U.downgrade_expired(_subscribers(spark, sf), I.now())
    return after.select("id", "tier", F.date_format("subscription_expires_at", "yyyy-MM-dd").alias("expires"))


@query(I.with_(I.USERS_SQL, SUBSCRIBERS_SQL) + " SELECT id, chat_id, subscription_amount FROM hit")
def expired_users(spark, sf):
    return U.expired(_subscribers(spark, sf), I.now()).select("id", "chat_id", "subscription_amount")


@query(I.with_(I.USERS_SQL) + """
SELECT id AS user_id, CAST(ceil(experience_years) AS BIGINT) AS years, c_mktsegment AS primary_domain,
  'Python, AWS' AS skills_text FROM users JOIN customer USING (c_custkey)""")
def candidate_contexts(spark, sf):
    return candidate_context(I.users(spark, sf)).select("user_id", "years", "primary_domain", "skills_text")


@query(I.with_(I.USERS_SQL) + " SELECT id, email, is_active, chat_id, tier FROM users WHERE is_active AND tier = 'premium'")
def active_premium_users(spark, sf):
    return U.active_users(I.users(spark, sf), "premium", ["id", "email", "is_active", "chat_id", "tier"])


@query(I.with_("e AS (SELECT * FROM events)", "u AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS amount FROM customer)", """
latest AS (SELECT CAST(user_id * 11 AS VARCHAR) AS id, bool_or(event_type = 'signup') AS creates,
  arg_max(value, ts) FILTER (WHERE event_type IN ('purchase', 'signup')) AS amount,
  arg_max(event_type, ts) FILTER (WHERE event_type <> 'view') AS name FROM e GROUP BY user_id)""") + """
SELECT coalesce(u.id, l.id) AS id, coalesce(l.name, u.name) AS name,
  CASE WHEN u.id IS NULL THEN coalesce(l.amount, 0) ELSE coalesce(l.amount, u.amount) END AS subscription_amount,
  CASE WHEN u.id IS NULL THEN TRUE ELSE CAST(u.id AS BIGINT) % 7 <> 0 END AS is_active
FROM u FULL JOIN latest l ON l.id = u.id WHERE u.id IS NOT NULL OR l.creates""")
def apply_user_changes(spark, sf):
    """Events as a change feed; every eleventh user id, some of them new."""
    kind = F.col("event_type")
    changes = I.table(spark, sf, "events").select(
        (F.col("user_id") * 11).cast("string").alias("id"),
        F.when(kind == "signup", "create").otherwise("update").alias("op"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind.isin("purchase", "signup"), F.col("value")).alias("subscription_amount"),
        F.when(kind != "view", kind).alias("name"))
    base = I.users(spark, sf).select("id", "name", "subscription_amount", "is_active")
    return U.apply_user_changes(base, changes, I.now())


@query(I.with_(I.USERS_SQL, I.RUNS_SQL) + """
SELECT u.id, CAST(u.total_runs_count + coalesce(r.n, 0) AS INTEGER) AS total_runs_count, strftime(r.t, '%Y-%m-%d %H:%M:%S') AS last_run_at
FROM users u LEFT JOIN (SELECT user_id, count(*) AS n, max(run_at) AS t FROM runs WHERE status = 'SUCCESS' GROUP BY 1) r
  ON r.user_id = u.id""")
def refreshed_users(spark, sf):
    base = I.users(spark, sf).withColumn("last_run_at", F.lit(None).cast("timestamp"))
    out = U.refresh_user_counters(base, I.runs(spark, sf))
    return out.select("id", "total_runs_count", F.date_format("last_run_at", "yyyy-MM-dd HH:mm:ss").alias("last_run_at"))


UUID_TAIL = "-0000-4000-8000-0123456789ab"


@query(I.with_(I.USERS_SQL) + f"""
SELECT e.event_id, CASE event_id % 3 WHEN 0 THEN lpad(CAST(event_id AS VARCHAR), 8, '0') || '{UUID_TAIL}'
  WHEN 1 THEN u.id END AS user_id
FROM events e LEFT JOIN users u ON event_id % 3 = 1 AND u.c_custkey = e.user_id""")
def resolve_identifiers(spark, sf):
    """Requests naming users by uuid, by e-mail in odd case, or by nonsense."""
    k = F.col("event_id")
    mail = F.concat(F.lit(" CUSTOMER#"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@example.COM "))
    ident = (F.when(k % 3 == 0, F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit(UUID_TAIL)))
             .when(k % 3 == 1, mail).otherwise("nobody"))
    requests = I.table(spark, sf, "events").select("event_id", ident.alias("identifier"))
    return U.resolve_users(requests, I.users(spark, sf)).select("event_id", "user_id")


# --- validation ----------------------------------------------------------------------------------------

def _requests(spark, sf):
    e, k = I.table(spark, sf, "events"), F.col("event_id")
    none = F.lit(None).cast("string")
    return e.select(
        "event_id",
        F.when(k % 10 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("keyword"),
        F.when(k % 20 == 0, "Pune").alias("location"),
        F.when(k % 7 == 0, F.concat((k % 90).cast("string"), F.lit("hr"))).when(k % 7 == 1, "Past Week")
        .when(k % 7 == 2, "tomorrow").alias("dateSincePosted"),
        F.when(k % 4 == 0, "Full Time, contract").when(k % 4 == 1, "contract,slavery").alias("jobType"),
        F.when(k % 6 == 0, "senior").alias("experienceLevel"), none.alias("remoteFilter"),
        F.when(k % 8 == 0, "best").alias("sortBy"), (k % 130).cast("string").alias("limit"),
        F.when(k % 9 == 0, "-1").alias("page"), F.when(k % 2 == 0, "true").alias("easyApply"),
        none.alias("has_verification"), none.alias("under_10_applicants"))


ERRORS_SQL = """checked AS (SELECT event_id, [
  CASE WHEN event_id % 10 = 0 AND event_id % 20 <> 0 THEN 'Validation Error: Either "keyword" or "location" parameter must be provided.' END,
  CASE WHEN event_id % 7 = 2 THEN 'Validation Error: Invalid dateSincePosted "tomorrow". Allowed values: past month, past week, 24hr, past 24 hours, or dynamic hours e.g. "12hr", "6hr"' END,
  CASE WHEN event_id % 4 = 1 THEN 'Validation Error: Invalid jobType "slavery". Allowed values: full time, part time, contract, temporary, volunteer, internship' END,
  CASE WHEN event_id % 8 = 0 THEN 'Validation Error: Invalid sortBy "best". Allowed values: recent, relevant' END,
  CASE WHEN event_id % 130 NOT BETWEEN 1 AND 100 THEN 'Validation Error: Invalid limit "' || (event_id % 130) || '". Limit must be an integer between 1 and 100.' END,
  CASE WHEN event_id % 9 = 0 THEN 'Validation Error: Invalid page "-1". Page must be a non-negative integer >= 0.' END] AS errs FROM events)"""


@query(I.with_(ERRORS_SQL) + " SELECT event_id, array_to_string(list_filter(errs, lambda e: e IS NOT NULL), '; ') AS errors FROM checked")
def validate_rows(spark, sf):
    """Every failing rule of a search request."""
    return with_errors(_requests(spark, sf), search_rules("linkedin")).select("event_id", "errors")


@query(I.with_(ERRORS_SQL) + """
SELECT event_id, list_filter(errs, lambda e: e IS NOT NULL)[1] AS errors FROM checked
WHERE len(list_filter(errs, lambda e: e IS NOT NULL)) > 0""")
def quarantine(spark, sf):
    """Rejected requests with the first failing rule."""
    return validate(_requests(spark, sf), search_rules("linkedin"), first_only=True)[1].select("event_id", "errors")


@query("""
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS keyword, CASE WHEN event_id % 20 = 0 THEN 'Pune' END AS location,
  CASE WHEN event_id % 130 = 0 THEN 25 ELSE CAST(event_id % 130 AS INTEGER) END AS "limit",
  CASE WHEN event_id % 9 = 0 THEN -1 ELSE 0 END AS page, event_id % 2 = 0 AS "easyApply" FROM events""")
def request_defaults(spark, sf):
    return with_defaults(_requests(spark, sf), SEARCH_DEFAULTS).select(
        "event_id", "keyword", "location", "limit", "page", "easyApply")


@query("""
SELECT c_custkey, array_to_string(list_filter([
  CASE WHEN c_mktsegment <> 'BUILDING' THEN 'tier: Invalid option' END,
  CASE WHEN c_acctbal < 0 THEN 'subscriptionAmount: Subscription amount must be 0 or greater' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'subscriptionExpiresAt: Must be a valid ISO 8601 datetime string'
       WHEN c_custkey % 3 = 1 THEN 'subscriptionExpiresAt: Required' END], lambda e: e IS NOT NULL), '; ') AS errors FROM customer""")
def subscription_errors(spark, sf):
    k = F.col("c_custkey")
    rows = I.table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "premium").otherwise("gold").alias("tier"),
        F.col("c_acctbal").alias("subscriptionAmount"),
        F.when(k % 3 == 0, "soon").when(k % 3 == 2, "2024-05-01T10:00:00Z").alias("subscriptionExpiresAt"))
    return with_errors(rows, subscription_rules()).select("c_custkey", "errors")


PAGING_SQL = """CASE WHEN event_id % 130 NOT BETWEEN 1 AND 100 THEN 'Validation Error: Invalid limit "' || (event_id % 130) || '". Limit must be an integer between 1 and 100.' END,
  CASE WHEN event_id % 9 = 0 THEN 'Validation Error: Invalid page "-1". Page must be a non-negative integer.' END"""
SITE_ERRORS_SQL = f"""site_checked AS (
SELECT event_id, 'naukri' AS site, [
  CASE WHEN event_id % 10 = 0 THEN 'Validation Error: "keyword" parameter is required.' END,
  CASE WHEN event_id % 40 > 30 THEN 'Validation Error: Invalid experience "' || (event_id % 40) || '". Must be an integer between 0 and 30.' END,
  CASE WHEN event_id % 16 NOT IN (1, 3, 7, 15) THEN 'Validation Error: Invalid jobAge "' || (event_id % 16) || '". Allowed values: 1, 3, 7, 15, 30' END,
  CASE WHEN event_id % 8 = 0 THEN 'Validation Error: Invalid sort "best". Allowed values: relevance, date' END,
  CASE WHEN event_id % 6 = 0 THEN 'Validation Error: Invalid wfhType "moon". Allowed values: office, remote, hybrid' END, {PAGING_SQL}] AS errs FROM events
UNION ALL SELECT event_id, 'indeed', [
  CASE WHEN event_id % 10 = 0 AND event_id % 20 <> 0 THEN 'Validation Error: Either "keyword" or "location" parameter must be provided.' END,
  CASE WHEN event_id % 16 = 0 THEN 'Validation Error: Invalid fromage "0". Fromage must be a positive integer.' END,
  CASE WHEN event_id % 4 = 1 THEN 'Validation Error: Invalid jobType "slavery". Allowed values: fulltime, parttime, contract, internship, temporary' END,
  CASE WHEN event_id % 8 = 0 THEN 'Validation Error: Invalid sort "best". Allowed values: relevance, date' END, {PAGING_SQL}] FROM events
UNION ALL SELECT event_id, 'simplyhired', [
  CASE WHEN event_id % 10 = 0 AND event_id % 20 <> 0 THEN 'Validation Error: Either "keyword" or "location" parameter must be provided.' END,
  CASE WHEN event_id % 7 = 2 THEN 'Validation Error: Invalid datePosted "tomorrow". Allowed values: {", ".join(K.SIMPLYHIRED_DATES)}' END,
  CASE WHEN event_id % 4 = 1 THEN 'Validation Error: Invalid jobType "slavery". Allowed values: {", ".join(K.SIMPLYHIRED_JOB_TYPES)}' END,
  CASE WHEN event_id % 8 = 0 THEN 'Validation Error: Invalid sort "best". Allowed values: relevance, date' END,
  CASE WHEN event_id % 12 = 5 THEN 'Validation Error: Invalid distance "-3". Distance must be a non-negative integer.' END, {PAGING_SQL}] FROM events)"""


@query(I.with_(SITE_ERRORS_SQL) + " SELECT event_id, site, array_to_string(list_filter(errs, lambda e: e IS NOT NULL), '; ') AS errors FROM site_checked")
def site_request_errors(spark, sf):
    """Every failing rule of search requests to the three other sites."""
    e, k, out = I.table(spark, sf, "events"), F.col("event_id"), None
    text = lambda c: c.cast("string")
    common = {
        "keyword": F.when(k % 10 != 0, F.col("event_type")), "location": F.when(k % 20 == 0, "Pune"), "limit": text(k % 130),
        "page": F.when(k % 9 == 0, "-1"), "sort": F.when(k % 8 == 0, "best").when(k % 8 == 1, "Date")}
    own = {
        "naukri": {"experience": text(k % 40), "jobAge": text(k % 16), "wfhType": F.when(k % 6 == 0, "remote, moon").when(k % 6 == 1, "Office,hybrid")},
        "indeed": {"fromage": text(k % 16), "jobType": F.when(k % 4 == 1, "contract, slavery").when(k % 4 == 2, "fulltime,")},
        "simplyhired": {"datePosted": F.when(k % 7 == 2, "tomorrow").when(k % 7 == 3, "24HR"), "jobType": F.when(k % 4 == 1, "slavery"),
                        "distance": F.when(k % 12 == 5, "-3").when(k % 12 == 6, "40")}}
    for site, columns in own.items():
        rows = e.select("event_id", F.lit(site).alias("site"), *(c.alias(n) for n, c in {**common, **columns}.items()))
        rows = with_errors(rows, search_rules(site)).select("event_id", "site", "errors")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("""
SELECT o_orderkey, array_to_string(list_filter([
  CASE WHEN o_orderkey % 200 = 0 THEN 'lookbackHours: Lookback must be at least 1 hour'
       WHEN o_orderkey % 200 > 168 THEN 'lookbackHours: Lookback cannot exceed 168 hours (7 days)' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'targetUserId: targetUserId must be a valid UUID' END], lambda e: e IS NOT NULL), '; ') AS errors FROM orders""")
def run_request_errors(spark, sf):
    k = F.col("o_orderkey")
    good = hex_id("o_orderkey")
    rows = I.table(spark, sf, "orders").select("o_orderkey", (k % 200).cast("double").alias("lookbackHours"), F.when(
        k % 3 == 0, F.substring(good, 2, 40)).when(k % 3 == 1, F.upper(good)).alias("targetUserId"))
    return with_errors(rows, run_request_rules()).select("o_orderkey", "errors")


@query("""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN doc_id % 5 = 0 THEN 'email: Required' END, CASE WHEN text IS NULL THEN 'resumeText: Required' END,
  CASE WHEN doc_id % 5 = 1 THEN 'email: Must be a valid email address' END,
  CASE WHEN length(trim(text[1:130], ' ' || chr(9) || chr(10) || chr(13))) > 100 THEN 'name: Name cannot exceed 100 characters' END,
  CASE WHEN length(text) < 50 THEN 'resumeText: Resume plain text must be at least 50 characters long'
       WHEN length(text) > 15000 THEN 'resumeText: Resume plain text cannot exceed 15,000 characters' END,
  CASE WHEN lang = 'de' THEN 'tier: Invalid option' END,
  CASE WHEN n_chars > 10000 THEN 'subscriptionAmount: Too big: expected number to be <=10000' END,
  CASE WHEN doc_id % 60 > 50 THEN 'experienceYears: Too big: expected number to be <=50' END,
  CASE WHEN source NOT IN ('linkedin', 'whatsapp', 'other') THEN 'source: Source must be one of: linkedin, whatsapp, other' END], lambda e: e IS NOT NULL), '; ') AS errors FROM documents""")
def user_request_errors(spark, sf):
    """Create requests made of documents: every failing field."""
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    rows = I.table(spark, sf, "documents").select(
        "doc_id", F.when(k % 5 == 1, "a@b").when(k % 5 > 1, F.concat(F.lit("user.x"), k, F.lit("@mail.example.org"))).alias("email"),
        F.substring("text", 1, 130).alias("name"), F.col("text").alias("resumeText"),
        F.when(F.col("lang") == "de", "gold").otherwise("free").alias("tier"), F.col("n_chars").cast("double").alias("subscriptionAmount"),
        (k % 60).cast("double").alias("experienceYears"), "source", F.array().cast("array<string>").alias("excludeTitleKeywords"),
        *(none.alias(c) for c in ("phone", "telegramChatId", "linkedinPostTemplate", "subscriptionExpiresAt", "linkedinProfileUrl",
                                  "targetLocations", "employmentType", "primaryDomain", "candidateSummary")))
    return with_errors(rows, user_request_rules(create=True)).select("doc_id", "errors")


# --- texts --------------------------------------------------------------------------------------------

@query(I.with_(I.USERS_SQL, f"subs AS (SELECT *, {EXPIRES_SQL} AS expires FROM users)") + """
SELECT id, '📊 <b>Account Status</b>' || chr(10) || chr(10) || '👤 <b>User:</b> ' || name || chr(10) || '🆔 <b>ID:</b> ' || id || chr(10)
  || '🔄 <b>Status:</b> ' || CASE WHEN is_active THEN 'Active ✅' ELSE 'Paused ⏸️' END || chr(10)
  || CASE WHEN tier = 'premium' THEN '⭐ <b>Tier:</b> Premium (3 alerts/day)' ELSE '🔹 <b>Tier:</b> Free (1 alert/day)' END || chr(10)
  || CASE WHEN tier = 'free' THEN '💡 <b>Upgrade:</b> Contact admin for Premium at ₹500/month' || chr(10)
     WHEN expires IS NOT NULL THEN '📅 <b>Expires:</b> ' || strftime(expires + INTERVAL 330 MINUTE, '%-d/%-m/%Y')
       || CASE WHEN subscription_amount > 0 THEN ' (₹' || CASE WHEN subscription_amount = floor(subscription_amount)
         THEN CAST(CAST(subscription_amount AS BIGINT) AS VARCHAR) ELSE CAST(subscription_amount AS VARCHAR) END || '/month)' ELSE ' (Trial)' END || chr(10)
     ELSE '' END || '🚀 <b>Total Runs:</b> ' || total_runs_count AS message FROM subs""")
def account_status(spark, sf):
    return _subscribers(spark, sf).select("id", status_text().alias("message"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '🔎 ' ELSE '✨ ' END || '<b>JOB MATCH SUMMARY</b> • <code>'
  || strftime(ts + INTERVAL 330 MINUTE, '%d %b %Y, %I:%M ') || lower(strftime(ts + INTERVAL 330 MINUTE, '%p')) || ' IST</code>' || chr(10) || repeat('━', 26) || chr(10)
  || '📥 <b>Total Jobs Scraped:</b> <code>' || user_id || '</code>' || chr(10) || '🎯 <b>Final Matches Found:</b> '
  || CASE WHEN event_id % 5 = 0 THEN '<code>0</code>' || chr(10) || chr(10) || '☕️ <i>No matching jobs found in this run. Check back later!</i>'
     ELSE '<b>' || (event_id % 5) || '</b>' END AS header FROM events""")
def run_summaries(spark, sf):
    return I.table(spark, sf, "events").select(
        "event_id", run_summary(F.col("ts").cast("timestamp"), F.col("user_id"), F.col("event_id") % 5).alias("header"))


@query("""
SELECT c_custkey, '# ' || c_name || chr(10) || chr(10) || 'm@x.org | City: ' || c_mktsegment || chr(10) || chr(10)
  || '## Summary' || chr(10) || chr(10) || 'S' || chr(10) || chr(10) || '## Skills' || chr(10) || chr(10) || 'a, ' || c_mktsegment
  || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || '## Work Experience' || chr(10) || chr(10) || '### T — C (2020)' || chr(10) || chr(10) || '- ' || c_name ELSE '' END
  || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || '## Education' || chr(10) || chr(10) || '- B, I (2019)' ELSE '' END
  || CASE WHEN c_custkey % 5 = 0 THEN chr(10) || chr(10) || '## Projects' || chr(10) || chr(10) || '### P — x, y' || chr(10) || chr(10) || 'D' ELSE '' END AS md
FROM customer""")
def resume_markdown(spark, sf):
    t = {f.name: f.dataType for f in RESUME.fields}
    k = F.col("c_custkey")
    s = lambda **kw: F.struct(*[v.alias(n) for n, v in kw.items()])
    experience = F.when(k % 2 == 0, F.array(s(
        title=F.lit("T"), company=F.lit("C"), dates=F.lit("2020"), bullets=F.array("c_name")))).cast(t["experience"])
    education = F.when(k % 3 == 0, F.array(s(
        degree=F.lit("B"), institution=F.lit("I"), dates=F.lit("2019")))).cast(t["education"])
    projects = F.when(k % 5 == 0, F.array(s(
        name=F.lit("P"), description=F.lit("D"), technologies=F.array(F.lit("x"), F.lit("y"))))).cast(t["projects"])
    resume = s(contact_details=F.create_map(F.lit("City"), F.col("c_mktsegment")), summary=F.lit("S"),
               experience=experience, skills=F.array(F.lit("a"), F.col("c_mktsegment")), education=education,
               projects=projects)
    return I.table(spark, sf, "customer").withColumn("resume", resume).select(
        "c_custkey", to_markdown("resume", "c_name", F.lit("m@x.org")).alias("md"))
