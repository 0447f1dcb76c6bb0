"""Posting rules, fit, skills, the whole cascade, digests and posts."""

from pyspark.sql import functions as F

from siftwell.functions.fit import evaluate_fit
from siftwell.functions.render import fill_template, post_text
from siftwell.operators.phrases import block_listed, find_names, plain_words
from siftwell.operators.queue import build_post_messages, post_status, read_messages, release_slots
from siftwell.operators.rules import (
    company_block as block_companies, fresh, keyword_filter as exclude_keywords,
    seniority_filter as exclude_seniority, yoe_filter as exclude_yoe,
)
from siftwell.operators.skills import match_skills, implied_skills, mention_skills
from siftwell.plans.cascade import audit_rows, classify, funnel, stage_postings
from siftwell.plans.digest import digest_cards, rank_digest
from siftwell.workload import query
from siftwell.workload import inputs as I
from siftwell.workload.postings import FP, MENTIONS_SQL, VALID
from siftwell import constants as K

CAND = "CAST(ceil(u.experience_years) AS BIGINT)"


@query("""SELECT doc_id, lang || ' Corp' AS company_name, contains(lower(lang || ' Corp'), 'es corp') AS blocked FROM documents""")
def company_block(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit(" Corp")).alias("company_name"))
    return block_companies(d, I.BLOCKLIST)


@query(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS posted FROM orders
WHERE o_orderpriority IN ('5-LOW', '2-HIGH') OR o_orderdate >= TIMESTAMP '{I.RETENTION_NOW}' - INTERVAL 14 DAY""")
def freshness(spark, sf):
    """Missing and unreadable dates pass."""
    k = F.col("o_orderkey")
    rows = I.table(spark, sf, "orders").select(
        k.cast("string").alias("id"), F.col("o_orderdate").alias("posted"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
        .when(F.col("o_orderpriority") == "2-HIGH", "2 days ago")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("posted_at"))
    return fresh(rows, I.now(I.RETENTION_NOW)).select("id", "posted")


def _with_user(spark, sf):
    u = I.users(spark, sf).select(
        F.col("id").alias("user_id"), "exclude_title_keywords", "experience_years",
        F.ceil("experience_years").alias("candidate_years"))
    return I.postings(spark, sf).join(u, "user_id")


@query(I.with_(I.POSTINGS_SQL, I.USERS_SQL) + """
SELECT ord, nullif(array_to_string(list_filter(u.excludes, lambda k: contains(lower(title) || ' ' || lower(seniority_level), k)), ', '), '') AS reason
FROM postings p JOIN users u ON u.id = p.user_id""")
def keyword_filter(spark, sf):
    return exclude_keywords(_with_user(spark, sf)).select("ord", "reason")


def _first_keyword_sql(text: str, words) -> str:
    cases = " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in words)
    return f"CASE {cases} END"


SENIORITY_SQL = f"""CASE WHEN {CAND} > 5 THEN {_first_keyword_sql('lower(title)', K.JUNIOR_TITLE_KEYWORDS)}
    ELSE {_first_keyword_sql('lower(title)', K.SENIOR_TITLE_KEYWORDS)} END"""


@query(I.with_(I.POSTINGS_SQL, I.USERS_SQL) + f"""
SELECT ord, 'Seniority: "' || kw || '"' || CASE WHEN years > 5 THEN ' (junior role)' ELSE '' END
  || ' in title, candidate has ' || years || ' YOE' AS reason
FROM (SELECT ord, {SENIORITY_SQL} AS kw, {CAND} AS years FROM postings p JOIN users u ON u.id = p.user_id)""")
def seniority_filter(spark, sf):
    return exclude_seniority(_with_user(spark, sf)).select("ord", "reason")


POSTING_TEXT_SQL = "texts AS (SELECT ord AS k, description_text || ' ' || seniority_level AS txt FROM postings)"
FRESHER_SQL = r"regexp_matches(txt, '(?i)\b(?:freshers?|fresh[ -]?graduat(?:es?|ion))\b')"
YOE_REASON_SQL = f"""CASE WHEN yoe_min > {CAND} THEN 'YOE: requires ' || CAST(yoe_min AS BIGINT) || '+ yr, candidate has ' || {CAND} || ' yr'
    WHEN yoe_max < {CAND} AND NOT {FRESHER_SQL} THEN 'YOE: requires ' || CAST(yoe_max AS BIGINT) || '- yr max, candidate has ' || {CAND} || ' yr' END"""


@query(I.with_(I.POSTINGS_SQL, I.USERS_SQL, POSTING_TEXT_SQL, MENTIONS_SQL) + f"""
SELECT ord, yoe_min, yoe_max, yoe_text AS extracted_yoe_text, {YOE_REASON_SQL} AS reason
FROM postings p JOIN users u ON u.id = p.user_id JOIN texts ON texts.k = p.ord LEFT JOIN yoe ON yoe.k = p.ord""")
def yoe_filter(spark, sf):
    return exclude_yoe(_with_user(spark, sf)).select("ord", "yoe_min", "yoe_max", "extracted_yoe_text", "reason")


@query(I.with_(I.POSTINGS_SQL, I.USERS_SQL, POSTING_TEXT_SQL, MENTIONS_SQL) + f"""
SELECT count(*) AS rejected, count(*) FILTER (WHERE yoe_min > years) AS underqualified,
  count(*) FILTER (WHERE NOT coalesce(yoe_min > years, FALSE)) AS overqualified
FROM (SELECT yoe_min, {CAND} AS years, {YOE_REASON_SQL} AS reason FROM postings p JOIN users u ON u.id = p.user_id
  JOIN texts ON texts.k = p.ord LEFT JOIN yoe ON yoe.k = p.ord) WHERE reason IS NOT NULL""")
def yoe_reject_summary(spark, sf):
    from siftwell.plans.reports import prefilter_summary

    return prefilter_summary(exclude_yoe(_with_user(spark, sf)))


# --- the cascade -----------------------------------------------------------------------------------

CASCADE_SQL = I.with_(I.POSTINGS_SQL, I.USERS_SQL, I.HISTORY_SQL, POSTING_TEXT_SQL, MENTIONS_SQL, f"""classed AS (
  SELECT p.user_id, p.ord, {FP} AS fp, contains(lower(company_name), 'es corp') AS blocked, {VALID} AS valid,
    CASE WHEN TRY_CAST(posted_at AS TIMESTAMP) < TIMESTAMP '{I.NOW}' - INTERVAL 14 DAY THEN 'outdated'
      WHEN len(list_filter(u.excludes, lambda k: contains(lower(title) || ' ' || lower(seniority_level), k))) > 0 THEN 'keyword'
      WHEN ({YOE_REASON_SQL}) IS NOT NULL THEN 'yoe' WHEN ({SENIORITY_SQL}) IS NOT NULL THEN 'seniority'
      ELSE 'evaluate' END AS rule
  FROM postings p JOIN users u ON u.id = p.user_id AND u.is_active
  JOIN texts ON texts.k = p.ord LEFT JOIN yoe ON yoe.k = p.ord)""", """staged AS (
  SELECT c.*, CASE WHEN blocked THEN 'blocked' WHEN NOT valid THEN 'invalid'
    WHEN row_number() OVER (PARTITION BY user_id, blocked, valid, fp ORDER BY ord) > 1 THEN 'duplicate'
    WHEN EXISTS (SELECT 1 FROM history h WHERE h.user_id = c.user_id AND h.fingerprint = c.fp) THEN 'known'
    ELSE rule END AS stage FROM classed c)""", """counts AS (
  SELECT user_id, count(*) AS scraped, count(*) FILTER (WHERE stage = 'blocked') AS blocked,
    count(*) FILTER (WHERE stage = 'invalid') AS invalid, count(*) FILTER (WHERE stage = 'duplicate') AS duplicates,
    count(*) FILTER (WHERE stage = 'known') AS known, count(*) FILTER (WHERE stage = 'outdated') AS outdated,
    count(*) FILTER (WHERE stage = 'keyword') AS keyword, count(*) FILTER (WHERE stage = 'yoe') AS yoe,
    count(*) FILTER (WHERE stage = 'seniority') AS seniority, count(*) FILTER (WHERE stage = 'evaluate') AS evaluated
  FROM staged GROUP BY user_id)""")


def _staged(spark, sf, carry=()):
    rows = classify(I.postings(spark, sf), I.users(spark, sf), I.now(), I.BLOCKLIST)
    return stage_postings(rows, I.history(spark, sf), carry)


@query(CASCADE_SQL + " SELECT user_id, ord, fp AS fingerprint FROM staged WHERE stage = 'evaluate'")
def cascade_survivors(spark, sf):
    """Postings that pass every rule and go to evaluation."""
    return _staged(spark, sf).filter(F.col("stage") == "evaluate").select("user_id", "ord", "fingerprint")


@query(CASCADE_SQL + " SELECT * FROM counts")
def funnel_by_user(spark, sf):
    return funnel(_staged(spark, sf))


@query(CASCADE_SQL + """
SELECT user_id, scraped AS scraped_jobs_count, invalid + duplicates AS batch_dedup_count, known AS db_dedup_count,
  keyword + CASE WHEN e IN ('yoe_filter', 'seniority_filter') THEN yoe ELSE 0 END
    + CASE WHEN e = 'seniority_filter' THEN seniority ELSE 0 END AS keyword_filtered_count, e AS exit_stage
FROM (SELECT *, CASE WHEN scraped = blocked THEN 'blocked_companies'
  WHEN scraped = blocked + invalid + duplicates THEN 'batch_dedup'
  WHEN scraped = blocked + invalid + duplicates + known THEN 'db_dedup'
  WHEN scraped = blocked + invalid + duplicates + known + outdated + keyword THEN 'keyword_filter'
  WHEN evaluated + seniority = 0 THEN 'yoe_filter' WHEN evaluated = 0 THEN 'seniority_filter'
  ELSE 'ai_evaluation' END AS e FROM counts)""")
def run_audit(spark, sf):
    rows = audit_rows(funnel(_staged(spark, sf)), None, I.now())
    return rows.select("user_id", "scraped_jobs_count", "batch_dedup_count", "db_dedup_count",
                       "keyword_filtered_count", "exit_stage")


# --- fit ----------------------------------------------------------------------------------------------

def _facts(spark, sf):
    p, k, s = I.table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    words = F.split("p_name", " ")
    none = F.array().cast("array<string>")
    required = F.when(k % 6 == 0, none).otherwise(F.concat(words, F.array("p_brand")))
    preferred = F.when(k % 4 == 0, none).otherwise(F.array("p_type"))
    got_required = F.slice(required, 1, (s % 4).cast("int"))
    got_preferred = F.when(s % 2 == 0, F.transform(preferred, F.lower)).otherwise(none)
    return p.select(
        "p_partkey", (s % 9).cast("double").alias("experience_years"),
        F.struct(
            F.lit("x").alias("job_domain"),
            F.when(k % 3 == 0, (s % 7).cast("double")).alias("min_required_yoe"),
            F.when(k % 5 == 0, (s % 7 + 2.5).cast("double")).alias("max_required_yoe"),
            required.alias("required_skills"), preferred.alias("preferred_skills"),
            got_required.alias("candidate_matched_required_skills"),
            got_preferred.alias("candidate_matched_preferred_skills"),
            (k % 2 == 0).alias("domain_matches_candidate"),
            F.lit(None).cast("string").alias("job_location"), F.lit(None).cast("string").alias("direct_apply"),
        ).alias("facts"))


NUM = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
FIT_SQL = f"""WITH raw AS (
  SELECT p_partkey AS k, CAST(p_size % 9 AS BIGINT) AS years, p_partkey % 2 = 0 AS domain,
    CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 7 AS DOUBLE) END AS lo,
    CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size % 7 + 2.5 AS DOUBLE) END AS hi,
    CASE WHEN p_partkey % 6 = 0 THEN [] ELSE list_append(string_split(p_name, ' '), p_brand) END AS req,
    CASE WHEN p_partkey % 4 = 0 THEN [] ELSE [p_type] END AS pref, p_size FROM part),
f AS (
  SELECT *, list_slice(req, 1, p_size % 4) AS greq,
    CASE WHEN p_size % 2 = 0 THEN list_transform(pref, lambda x: lower(x)) ELSE [] END AS gpref FROM raw),
g AS (
  SELECT *, list_filter(req, lambda x: NOT list_contains(list_transform(greq, lambda y: lower(y)), lower(x))) AS mreq,
    list_filter(pref, lambda x: NOT list_contains(list_transform(gpref, lambda y: lower(y)), lower(x))) AS mpref,
    CASE WHEN len(req) > 0 THEN len(greq) / len(req) END AS cov,
    CASE WHEN len(pref) > 0 THEN len(gpref) / len(pref) END AS pcov FROM f),
c AS (
  SELECT *, CASE WHEN years < lo OR years > hi THEN 'experience_mismatch'
    WHEN len(req) = 0 AND len(pref) = 0 THEN CASE WHEN domain THEN 'no_skills_domain_match' ELSE 'no_skills_domain_mismatch' END
    WHEN len(req) > 0 THEN CASE WHEN cov >= 0.8 THEN 'required_strong' WHEN cov < 0.6 THEN 'required_mismatch'
      WHEN pcov >= 0.8 THEN 'required_bonus' ELSE 'required_minor' END
    ELSE CASE WHEN pcov >= 0.8 THEN 'preferred_strong' WHEN pcov >= 0.6 THEN 'preferred_minor' ELSE 'preferred_no_match' END
    END AS fit_case,
    CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN {NUM('lo')} || '-' || {NUM('hi')} || ' years'
      WHEN lo IS NOT NULL THEN {NUM('lo')} || '+ years' WHEN hi IS NOT NULL THEN '0-' || {NUM('hi')} || ' years'
      ELSE 'Not specified' END AS label FROM g),
e AS (
  SELECT *, CASE WHEN fit_case LIKE 'no_skills%' OR fit_case LIKE 'preferred%' THEN [] ELSE mreq END AS omreq,
    CASE WHEN fit_case LIKE 'no_skills%' THEN [] ELSE mpref END AS ompref,
    CASE WHEN fit_case IN ('required_strong', 'required_bonus', 'preferred_strong') THEN 'strong_match'
      WHEN fit_case IN ('required_minor', 'preferred_minor') THEN 'minor_gaps'
      WHEN fit_case = 'required_mismatch' THEN 'skills_mismatch' WHEN fit_case = 'experience_mismatch' THEN fit_case
      ELSE 'no_match' END AS category,
    CASE WHEN fit_case = 'experience_mismatch' THEN 'Candidate has ' || years || ' YOE; job requires ' || label || '.'
      WHEN fit_case = 'no_skills_domain_match' THEN 'No explicit skills listed; domain matches but skill extraction unavailable — not sent.'
      WHEN fit_case = 'no_skills_domain_mismatch' THEN 'No explicit skills listed and domain does not match candidate.'
      WHEN fit_case LIKE 'required%' THEN len(greq) || '/' || len(req) || ' required skills matched'
        || CASE WHEN fit_case <> 'required_strong' AND len(mreq) > 0 THEN '; missing: ' || array_to_string(mreq, ', ') ELSE '' END || '.'
        || CASE WHEN fit_case = 'required_bonus' THEN ' Preferred skills also strongly matched (' || len(gpref) || '/' || len(pref) || ').' ELSE '' END
      ELSE '0/' || len(pref) || ' preferred skills matched.' END AS reason FROM c)
"""
SCORE_SQL = """CASE category WHEN 'strong_match' THEN 10 WHEN 'minor_gaps' THEN 7 WHEN 'experience_mismatch' THEN 2
    WHEN 'skills_mismatch' THEN 1 ELSE 0 END"""


@query(FIT_SQL + f"""
SELECT k AS p_partkey, category, {SCORE_SQL} AS score, reason,
  CASE WHEN category IN ('strong_match', 'minor_gaps') THEN 'matched' ELSE 'rejected' END AS status,
  array_to_string(omreq, '|') AS missing_required, array_to_string(ompref, '|') AS missing_preferred,
  array_to_string(list_concat(greq, list_filter(gpref, lambda x: NOT list_contains(greq, x))), '|') AS matched_skills FROM e""")
def fit_evaluate(spark, sf):
    out = evaluate_fit(_facts(spark, sf))
    return out.select(
        "p_partkey", "category", "score", "reason", "status",
        *[F.array_join(c, "|").alias(c) for c in ("missing_required", "missing_preferred", "matched_skills")])


@query(FIT_SQL + f"SELECT category, {SCORE_SQL} AS score, count(*) AS n FROM e GROUP BY ALL")
def fit_summary(spark, sf):
    return evaluate_fit(_facts(spark, sf)).groupBy("category", "score").agg(F.count(F.lit(1)).alias("n"))


def _sql_map(implied: dict) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, vs in implied.items() for v in vs)
    return f"(VALUES {rows}) t(skill, implied)"


WANTED = ["AWS", "JavaScript", "Python", "React", "MySQL", "Kafka", "Kubernetes", "Redis"]
OWNED = ["node.js", "Django", "Vue", "GCP", "oracle", "RabbitMQ", "typescript"]


@query(f"""
WITH rows AS (
  SELECT p_partkey, [{', '.join(repr(w) for w in WANTED)}] AS wanted,
    list_filter([{', '.join(repr(w) for w in OWNED)}], lambda s, i: (p_size >> (i - 1)) % 2 = 1) AS known FROM part),
own AS (SELECT p_partkey, lower(unnest(known)) AS skill FROM rows),
strict AS (
  SELECT p_partkey, skill FROM own UNION SELECT p_partkey, implied FROM own JOIN {_sql_map(implied_skills())} ON own.skill = t.skill),
loose AS (
  SELECT p_partkey, skill FROM own UNION
  SELECT p_partkey, implied FROM own JOIN {_sql_map(implied_skills(extra_groups=K.PREFERRED_SKILL_GROUPS))} ON own.skill = t.skill)
SELECT p_partkey,
  array_to_string(list_filter(wanted, lambda w: list_contains(coalesce(s, []), lower(w))), '|') AS required_hit,
  array_to_string(list_filter(wanted, lambda w: list_contains(coalesce(l, []), lower(w))), '|') AS preferred_hit
FROM rows LEFT JOIN (SELECT p_partkey AS a, list(skill) AS s FROM strict GROUP BY 1) ON a = p_partkey
LEFT JOIN (SELECT p_partkey AS b, list(skill) AS l FROM loose GROUP BY 1) ON b = p_partkey""")
def skill_equivalence(spark, sf):
    """Which of eight wanted skills a candidate has, given a subset of seven owned ones."""
    wanted = F.array(*[F.lit(w) for w in WANTED])
    known = F.array_compact(F.array(*[
        F.when(F.shiftright("p_size", i) % 2 == 1, F.lit(s)) for i, s in enumerate(OWNED)]))
    rows = I.table(spark, sf, "part").select(
        "p_partkey", wanted.alias("required_skills"), wanted.alias("preferred_skills"), known.alias("known_skills"))
    out = match_skills(rows)
    return out.select(
        "p_partkey", F.array_join("candidate_matched_required_skills", "|").alias("required_hit"),
        F.array_join("candidate_matched_preferred_skills", "|").alias("preferred_hit"))


MENTION_WORDS = ["the", "of", "der", "la", "new relic"]


@query(f"""
WITH t AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '(?:\\s|[,;:()!?]|\\.(?:\\s|$))+', ' ', 'g') || ' ' AS p FROM documents)
SELECT doc_id, array_to_string(list_filter([{', '.join(repr(w) for w in MENTION_WORDS)}],
  lambda w: contains(p, ' ' || w || ' ')), '|') AS skills FROM t""")
def skill_mentions(spark, sf):
    """Dictionary terms found as whole words in the text."""
    out = mention_skills(I.table(spark, sf, "documents"), "text", "found", MENTION_WORDS)
    return out.select("doc_id", F.array_join("found", "|").alias("skills"))


PLAIN_SQL = "' ' || regexp_replace(lower({0}), '(?:\\s|[,;:()!?]|\\.(?:\\s|$))+', ' ', 'g') || ' '"
#: Every two words that follow each other in the benchmark are one name.
PHRASES_SQL = f"""item_words AS (SELECT item_id, list_filter(string_split({PLAIN_SQL.format('text')}, ' '), lambda w: w <> '') AS w FROM benchmark),
phrases AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS name FROM item_words, unnest(generate_series(1, len(w) - 1)) AS u(i)),
doc_words AS (SELECT doc_id, list_filter(string_split({PLAIN_SQL.format('text')}, ' '), lambda w: w <> '') AS w FROM documents),
hits AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS name FROM doc_words, unnest(generate_series(1, len(w) - 1)) AS u(i))
  SEMI JOIN phrases USING (name))"""


@query(I.with_(PHRASES_SQL) + """
SELECT doc_id, count(name) AS n_found, coalesce(sha256(string_agg(name, '|' ORDER BY name)), sha256('')) AS found_sha256
FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id""")
def phrase_mentions(spark, sf):
    """A dictionary of thousands of two-word names, made from the benchmark, found in all documents."""
    words = F.filter(F.split(plain_words("text"), " "), lambda w: w != "")
    follows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 1)), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    names = I.table(spark, sf, "benchmark").select(words.alias("w")).where(F.size("w") > 1).select(F.explode(follows).alias("name"))
    return find_names(I.table(spark, sf, "documents"), "text", names).select(
        "doc_id", F.size("found").cast("bigint").alias("n_found"), F.sha2(F.array_join("found", "|"), 256).alias("found_sha256"))


@query("""
WITH names AS (SELECT DISTINCT 'or#' || right(s_name, 9) AS name FROM supplier)
SELECT o_orderkey, EXISTS (SELECT 1 FROM names n WHERE contains(lower('Operator#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')), n.name)) AS blocked FROM orders""")
def company_block_list(spark, sf):
    """Companies against a block list as long as the supplier table, which stays distributed."""
    names = I.table(spark, sf, "supplier").select(F.concat(F.lit("OR#"), F.right("s_name", F.lit(9))).alias("name"))
    rows = I.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Operator#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("company_name"))
    return block_listed(rows, names, most_bytes=0).select("o_orderkey", "blocked")


# --- digest, posts, queue ---------------------------------------------------------------------------------

DIGEST_SQL = I.with_(I.SCORED_SQL) + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(ai_score, 0) DESC, ord) AS rank FROM scored)"""


@query(DIGEST_SQL + " SELECT user_id, ord, rank FROM ranked")
def digest_rank(spark, sf):
    ranked = rank_digest(I.scored(spark, sf), bucket=[F.floor(F.col("ord") / 65536)])
    return ranked.select("user_id", "ord", "rank")


def _cards(df):
    none = F.lit(None).cast("string")
    k = F.col("ord")
    return df.withColumns({
        "company_name": F.col("status"), "ai_job_location": F.when(k % 2 == 0, "Pune"), "posted_at": none,
        "source": F.when(k % 3 == 0, "naukri"), "link": F.concat(F.lit("https://x.org/a b?k="), k.cast("string")),
        "min_required_yoe": F.when(k % 4 == 0, (k % 5).cast("double")),
        "max_required_yoe": F.when(k % 8 == 0, (k % 5 + 2).cast("double")),
        "direct_apply": F.when(k % 5 == 0, "hr@x.org"), "ai_reason": F.lit("Good."),
        "matched_skills": F.array(F.lit("Java"), F.col("title")), "missing_skills": F.array().cast("array<string>"),
    })


@query(DIGEST_SQL + """
SELECT ord, '<b>[ #' || rank || ' ] — ' || title || '</b>' || chr(10) || repeat('─', 20) || chr(10)
  || CASE WHEN ord % 3 = 0 THEN '💼 <b>Source:</b> <code>Naukri</code>' || chr(10) ELSE '' END
  || '🏢 <b>Company:</b>  <code>' || status || '</code>' || chr(10)
  || '📍 <b>Location:</b> <code>' || CASE WHEN ord % 2 = 0 THEN 'Pune' ELSE 'Not specified' END || '</code>' || chr(10)
  || '📅 <b>Posted:</b> <code>Unknown</code>' || chr(10)
  || '⏳ <b>Experience:</b> <code>' || CASE WHEN ord % 8 = 0 THEN (ord % 5) || '-' || (ord % 5 + 2) || ' YOE'
      WHEN ord % 4 = 0 THEN (ord % 5) || ' YOE' ELSE 'Not specified' END || '</code>' || chr(10) || chr(10)
  || CASE WHEN ai_score >= 8 THEN '✅' ELSE '⚠️' END || ' <b>Match Score:</b> <code>' || coalesce(CAST(ai_score AS VARCHAR), '') || '/10</code>' || chr(10)
  || CASE WHEN ord % 5 = 0 THEN '📩 <b>Direct Apply:</b> <i>hr@x.org</i>' || chr(10) ELSE '' END
  || '✅ <b>Matched Skills:</b> <i>Java, ' || title || '</i>' || chr(10) || chr(10)
  || '📝 <b>AI Reason:</b> <i>Good.</i>' || chr(10) || chr(10)
  || chr(10) || '🚀 <a href="https://app/redirect.html?jobId=' || id || '&source=telegram&type=apply&target=https%3A%2F%2Fx.org%2Fa%20b%3Fk%3D' || ord
  || '"><b>APPLY ON ' || CASE WHEN ord % 3 = 0 THEN 'NAUKRI' ELSE 'LINKEDIN' END || '</b></a>' || chr(10)
  || chr(10) || '📄 <a href="https://app/resume.html?id=' || id || '&jobId=' || id || '&source=telegram&type=resume"><b>VIEW & PRINT ATS RESUME</b></a>' AS card
FROM ranked""")
def match_cards(spark, sf):
    rows = _cards(I.scored(spark, sf))
    cards = digest_cards(rows, "https://app", bucket=[F.floor(F.col("ord") / 65536)])
    return cards.select("ord", "card")


TEMPLATE = "Hi {title}! {companyName} {unknown} {{title}} pays {salary}. {skills}"


@query("""
SELECT p_partkey, 'Hi ' || p_name || '! {title} {unknown} {' || p_name || '} pays ' || p_size || '. - a' || chr(10) || '- ' || p_type AS post
FROM part""")
def render_template(spark, sf):
    """One-pass filling: a value that looks like a placeholder is left alone."""
    needs = F.array_join(F.transform(F.array(F.lit("a"), F.col("p_type")), lambda s: F.concat(F.lit("- "), s)), "\n")
    values = {"title": F.col("p_name"), "companyName": F.lit("{title}"), "salary": F.col("p_size").cast("string"),
              "skills": needs}
    return I.table(spark, sf, "part").select("p_partkey", fill_template(F.lit(TEMPLATE), values).alias("post"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Job: ' || p_name || ' / India' ELSE
  a_company || ' is hiring for the role of ' || p_name || chr(10) || '📍 Location : India' || chr(10)
  || '💼 Employment : Full-time (' || p_type || ')' || chr(10)
  || CASE WHEN p_partkey % 2 = 0 THEN '⏳ Experience : ' || (p_size % 5) || ' YOE' || chr(10) ELSE '' END
  || chr(10) || 'Requirements :' || chr(10) || '- ' || p_type || chr(10)
  || chr(10) || chr(10) || '🔗 Apply link : https://x.org/' || p_partkey || chr(10) || chr(10) || 'Call 1' END AS post
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'a company' ELSE p_brand END AS a_company FROM part)""")
def post_texts(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    rows = I.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.when(k % 3 != 0, F.col("p_brand")).alias("company_name"),
        none.alias("ai_job_location"), F.lit("").alias("location"), F.lit("Full-time").alias("employment_type"),
        F.col("p_type").alias("seniority_level"), none.alias("salary"), none.alias("direct_apply"),
        F.concat(F.lit("https://x.org/"), k.cast("string")).alias("link"),
        F.array("p_type").alias("required_skills"), F.array("p_type").alias("preferred_skills"),
        F.when(k % 2 == 0, (s % 5).cast("double")).alias("min_required_yoe"),
        F.lit(None).cast("double").alias("max_required_yoe"),
        F.when(s % 2 == 0, "Job: {title} / {location}").otherwise("  ").alias("template"), F.lit("1").alias("phone"))
    return rows.select("p_partkey", post_text("template", "phone", footer="Call {userPhone}").alias("post"))


@query(I.with_(I.SCORED_SQL) + """
SELECT s.user_id, ord, '{"platform":"linkedin","userId":"' || s.user_id || '","job":{"title":"' || title || '","link":"u' || ord || '"}}' AS message
FROM scored s JOIN customer c ON s.user_id = CAST(c_custkey AS VARCHAR) WHERE c_mktsegment = 'BUILDING' AND ai_score >= 7""")
def post_messages(spark, sf):
    """Queue messages of matched postings for users with credentials."""
    none, nums = F.lit(None).cast("string"), F.lit(None).cast("double")
    lists = F.lit(None).cast("array<string>")
    matched = I.scored(spark, sf).filter(F.col("ai_score") >= 7).withColumns({
        "link": F.concat(F.lit("u"), F.col("ord").cast("string")), "company_name": none, "ai_job_location": none,
        "location": none, "required_skills": lists, "preferred_skills": lists, "min_required_yoe": nums,
        "max_required_yoe": nums, "employment_type": none, "seniority_level": none, "salary": none,
        "direct_apply": none})
    token = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("t"))
    users = I.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.struct(token.alias("accessToken"), F.lit("p").alias("personUrn")).alias("credentials"))
    return build_post_messages(matched, users)


@query("""
SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'unknown_user' WHEN c_custkey % 2 = 1 THEN 'no_credentials' ELSE 'ready' END AS status,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ': ' || event_type END AS post
FROM events LEFT JOIN customer ON c_custkey = user_id * 17""")
def post_statuses(spark, sf):
    """Queue messages read back, checked against their owners, and turned into post texts."""
    job = F.struct(F.col("event_type").alias("title"))
    body = F.struct(F.lit("linkedin").alias("platform"), (F.col("user_id") * 17).cast("string").alias("userId"), job.alias("job"))
    messages = read_messages(I.table(spark, sf, "events").select("event_id", F.to_json(body).alias("message")))
    token = F.when(F.col("c_custkey") % 2 == 0, F.lit("t"))
    owners = I.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.lit("1").alias("phone"),
        F.struct(token.alias("accessToken"), F.lit("p").alias("personUrn")).alias("credentials"),
        F.concat("c_mktsegment", F.lit(": {title}")).alias("post_template"))
    return post_status(messages, owners).select("event_id", "status", "post")


@query("""
SELECT event_id, user_id, strftime(TIMESTAMP '2024-02-01 00:00:00' + INTERVAL 30 MINUTE * (n - 1), '%Y-%m-%d %H:%M:%S') AS release_at
FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
def post_schedule_slots(spark, sf):
    q = I.table(spark, sf, "events").select(
        "event_id", "user_id", F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp").alias("enqueued_at"))
    return release_slots(q, I.now()).select(
        "event_id", "user_id", F.date_format("release_at", "yyyy-MM-dd HH:mm:ss").alias("release_at"))
