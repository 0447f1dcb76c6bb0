"""Keys, duplicates, ledger and text extraction."""

from pyspark.sql import functions as F

from siftwell.functions.experience import extract_yoe, fresher_friendly, yoe_label, yoe_short_label
from siftwell.functions.links import lookback_code, normalize_link, region_of, source_label
from siftwell.functions.text import fingerprint
from siftwell.operators.dedup import (
    cap_per_query, mark_known, new_only, unique_by_key, unique_in_batch, with_keys,
)
from siftwell.operators.ledger import (
    attach_ids, cascade_delete, description_objects, export_status, id_map, insert_if_absent, ledger_id,
    migrate, purge, apply_mapping as set_from_mapping,
)
from siftwell.operators.normalize import extraction_payload, normalize_jobs, to_ledger_rows
from siftwell.operators.rules import valid_posting
from siftwell.operators.versions import VersionedTable
from siftwell.schemas import RAW_POSTING
from siftwell.session import materialize, scratch_path
from siftwell.sources.tables import attach_texts
from siftwell.workload import query
from siftwell.workload import inputs as I

FP = I.FINGERPRINT_SQL
VALID = f"length({I.TRIMMED_SQL}) >= 300"
KEYED_SQL = f"""keyed AS (
  SELECT *, {FP} AS fingerprint, 'https://www.linkedin.com/jobs/view/' || ord AS job_link
  FROM postings WHERE {VALID}),
uniq AS (
  SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY user_id, fingerprint ORDER BY ord) = 1)"""


@query(I.with_(I.POSTINGS_SQL) + f" SELECT ord, user_id, {FP} AS fingerprint FROM postings")
def fingerprint_docs(spark, sf):
    return I.postings(spark, sf).select(
        "ord", "user_id", fingerprint("title", "company_name", "description_text").alias("fingerprint"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a ' || source ELSE source END AS title,
  CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END AS company_name,
  'http://x.org/' || doc_id AS link, CASE doc_id % 2 WHEN 0 THEN lang ELSE '' END AS seniority_level,
  lang AS posted_at, CASE WHEN doc_id % 5 = 0 THEN source ELSE 'linkedin' END AS source,
  length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS n_text
FROM documents""")
def normalize_postings(spark, sf):
    """Documents dressed in the different spellings scrapers use, then normalised."""
    d, k = I.table(spark, sf, "documents"), F.col("doc_id")
    some = lambda cond, value: F.when(cond, value).otherwise(F.lit(""))
    given = {
        "title": some(k % 3 == 0, F.concat(F.lit("a "), "source")), "position": F.col("source"),
        "companyName": F.when(k % 4 == 0, F.col("lang")), "company": F.col("source"),
        "link": some(k % 2 == 0, F.concat(F.lit("http://x.org/"), k.cast("string"))),
        "jobUrl": F.concat(F.lit("http://x.org/"), k.cast("string")),
        "descriptionText": F.when(k % 2 == 0, F.col("text")),
        "date": F.col("lang"), "source": F.when(k % 5 == 0, F.col("source")),
        "details": F.struct(*[
            {"descriptionText": F.col("text"), "seniorityLevel": F.when(k % 2 == 0, F.col("lang"))}
            .get(f.name, F.lit(None).cast("string")).alias(f.name) for f in RAW_POSTING["details"].dataType]),
    }
    job = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_POSTING])
    out = normalize_jobs(d.select("doc_id", job.alias("job")), keep=("doc_id",))
    return out.select("doc_id", "title", "company_name", "link", "seniority_level", "posted_at", "source",
                      F.length("description_text").cast("bigint").alias("n_text"))


@query(I.with_(I.POSTINGS_SQL) + f" SELECT ord, user_id FROM postings WHERE {VALID}")
def valid_postings(spark, sf):
    return valid_posting(I.postings(spark, sf)).select("ord", "user_id")


@query(I.with_(I.POSTINGS_SQL, KEYED_SQL) + " SELECT user_id, fingerprint, ord, job_link AS link FROM uniq")
def batch_dedup_first_wins(spark, sf):
    return unique_in_batch(I.postings(spark, sf)).select("user_id", "fingerprint", "ord", "link")


@query("""SELECT lang, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY lang, n_chars""")
def scrape_key_dedup(spark, sf):
    """First result per site key (here the length) inside a scrape (here a language)."""
    d = I.table(spark, sf, "documents").select("lang", "doc_id", F.col("n_chars").cast("string").alias("key"))
    rows = unique_by_key(d, ["lang"], "key", ["doc_id"])
    return rows.select("lang", F.col("key").cast("bigint").alias("n_chars"), "doc_id")


@query("""SELECT source, doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25""")
def query_result_cap(spark, sf):
    """The reference's own limit of 25 results per search query."""
    d = I.table(spark, sf, "documents").select("source", "doc_id")
    return cap_per_query(d, ["source"], ["doc_id"], 25)


@query(I.with_(I.POSTINGS_SQL, KEYED_SQL, I.HISTORY_SQL) + """
SELECT user_id, fingerprint, ord FROM uniq u
WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = u.user_id AND h.fingerprint = u.fingerprint)""")
def history_anti_join(spark, sf):
    rows = new_only(unique_in_batch(I.postings(spark, sf)), I.history(spark, sf))
    return rows.select("user_id", "fingerprint", "ord")


@query(I.with_(I.POSTINGS_SQL, KEYED_SQL, I.HISTORY_SQL) + """
SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM history h WHERE h.user_id = u.user_id
  AND h.fingerprint = u.fingerprint) THEN 1 ELSE 0 END) AS BIGINT) AS known FROM uniq u GROUP BY user_id""")
def history_known_counts(spark, sf):
    rows = mark_known(unique_in_batch(I.postings(spark, sf)), I.history(spark, sf))
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("known").alias("known"))


# --- ledger ---------------------------------------------------------------------------------------

def _offers(spark, sf):
    """Rows for the ledger whose links repeat: pages of one address, documents as their content."""
    rows = with_keys(I.postings(spark, sf))
    link = F.concat(F.lit("https://x.org/"), (F.col("ord") % 700).cast("string"))
    return rows.select("user_id", link.alias("job_link"), "fingerprint", "ord", "title")


def _stored(spark, sf):
    offers = _offers(spark, sf)
    good = I.table(spark, sf, "labels").filter(F.col("quality") == 0).select(F.col("doc_id").alias("ord"))
    rows = offers.join(good, "ord", "left_semi").withColumn("id", ledger_id())
    return rows.groupBy("user_id", "fingerprint").agg(
        F.min_by("job_link", "ord").alias("job_link"), F.min_by("id", "ord").alias("id"))


OFFERS_SQL = f"""offers AS (
  SELECT user_id, 'https://x.org/' || (ord % 700) AS job_link, {FP} AS fingerprint, ord, title FROM postings),
stored AS (
  SELECT user_id, fingerprint, arg_min(job_link, ord) AS job_link,
    sha256(user_id || '|' || fingerprint) AS id
  FROM offers WHERE ord IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY user_id, fingerprint),
lastrow AS (
  SELECT user_id, job_link, arg_max(fingerprint, ord) AS fingerprint, arg_max(title, ord) AS title,
    min(ord) AS ord FROM offers GROUP BY user_id, job_link),
fresh AS (
  SELECT * FROM lastrow l
  WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = l.user_id AND s.job_link = l.job_link)
    AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = l.user_id AND s.fingerprint = l.fingerprint)),
inserted AS (
  SELECT *, sha256(user_id || '|' || fingerprint) AS id FROM fresh
  QUALIFY row_number() OVER (PARTITION BY user_id, fingerprint ORDER BY ord) = 1)"""


@query(I.with_(I.POSTINGS_SQL, OFFERS_SQL) + " SELECT id, user_id, job_link, fingerprint, title, ord FROM inserted")
def ledger_insert_if_absent(spark, sf):
    offers, stored = materialize(_offers(spark, sf), "offers"), materialize(_stored(spark, sf), "stored")
    rows = insert_if_absent(offers, stored)
    return rows.select("id", "user_id", "job_link", "fingerprint", "title", "ord")


@query(I.with_(I.POSTINGS_SQL, OFFERS_SQL, """ids AS (
  SELECT user_id, job_link, fingerprint, id FROM inserted UNION ALL
  SELECT user_id, job_link, fingerprint, id FROM stored s
  WHERE EXISTS (SELECT 1 FROM offers o WHERE o.user_id = s.user_id AND o.job_link = s.job_link))""") + """
SELECT o.ord, o.user_id, coalesce(a.id, b.id) AS ledger_id FROM offers o
LEFT JOIN ids a ON a.user_id = o.user_id AND a.job_link = o.job_link
LEFT JOIN ids b ON b.user_id = o.user_id AND b.fingerprint = o.fingerprint""")
def ledger_id_map(spark, sf):
    offers, stored = materialize(_offers(spark, sf), "offers"), materialize(_stored(spark, sf), "stored")
    ids = id_map(offers, insert_if_absent(offers, stored), stored)
    return attach_ids(offers, ids).select("ord", "user_id", "ledger_id")


@query(I.with_(I.POSTINGS_SQL, f"keyed AS (SELECT *, {FP} AS fingerprint FROM postings)") + """
SELECT user_id, 'job-descriptions/' || user_id || '/' || sha256(user_id || '|' || fingerprint) || '.txt' AS key,
  length(description_text) AS n_chars FROM keyed""")
def description_store(spark, sf):
    """Description objects and their keys (the write itself is tested on a folder)."""
    rows = with_keys(I.postings(spark, sf)).withColumn("ledger_id", ledger_id(link="link"))
    return description_objects(rows).select(
        "user_id", "key", F.length("text").cast("bigint").alias("n_chars"))


PURGE_DAYS = 14


@query(I.with_(I.SCORED_SQL) + f"""
SELECT id, user_id FROM scored WHERE created_at >= TIMESTAMP '{I.RETENTION_NOW}' - INTERVAL {PURGE_DAYS} DAY""")
def purge_old(spark, sf):
    kept, _ = purge(I.scored(spark, sf), I.now(I.RETENTION_NOW), PURGE_DAYS)
    return kept.select("id", "user_id")


@query(I.with_(I.SCORED_SQL) + f"""
SELECT count(*) AS removed FROM scored WHERE created_at < TIMESTAMP '{I.RETENTION_NOW}' - INTERVAL {PURGE_DAYS} DAY""")
def purge_old_count(spark, sf):
    return purge(I.scored(spark, sf), I.now(I.RETENTION_NOW), PURGE_DAYS)[1]


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id,
  coalesce('key/' || l.n, o_orderstatus) AS description_key
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey) l
  ON l_orderkey = o_orderkey""")
def apply_mapping(spark, sf):
    rows = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("description_key"))
    mapping = I.table(spark, sf, "lineitem").filter(F.col("l_quantity") > 45).groupBy(
        F.col("l_orderkey").cast("string").alias("id")).agg(
        F.concat(F.lit("key/"), F.count(F.lit(1)).cast("string")).alias("new_value"))
    return set_from_mapping(rows, mapping, "id", "description_key")


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN -2 WHEN 3 THEN 8 WHEN 4 THEN -7 WHEN 5 THEN p_size END AS ai_score,
  CASE WHEN p_partkey % 4 = 0 THEN p_size + 0.5 END AS min_required_yoe, CASE WHEN p_partkey % 4 = 3 THEN p_size END AS max_required_yoe,
  CASE WHEN p_partkey % 3 = 0 THEN 'from facts' WHEN p_partkey % 3 = 1 THEN '' ELSE p_type END AS location,
  CASE WHEN p_partkey % 2 = 0 THEN 'facts apply' WHEN p_partkey % 5 = 0 THEN p_brand END AS direct_apply,
  CASE WHEN p_partkey % 7 <> 0 THEN p_container END AS applicants_count, p_partkey % 3 = 1 AS domain_matches_candidate,
  p_name AS job_title, 'because ' || p_brand AS ai_reason, p_brand || '|' || p_type AS required, '' AS preferred FROM
  (SELECT *, CAST(p_partkey AS VARCHAR) || ' asked' AS p_container FROM part)""")
def ledger_rows(spark, sf):
    """Ledger rows of evaluated parts: scores and years that are no numbers, ties below zero, fallbacks."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    nan, inf, none = F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    facts = F.struct(
        F.lit("d").alias("job_domain"), F.when(k % 4 == 0, size + 0.5).when(k % 4 == 1, nan).when(k % 4 == 2, inf).alias("min_required_yoe"),
        F.when(k % 4 == 3, size).when(k % 4 == 1, -inf).alias("max_required_yoe"), F.array("p_brand", "p_type").alias("required_skills"),
        F.lit(None).cast("array<string>").alias("preferred_skills"), empty.alias("candidate_matched_required_skills"),
        empty.alias("candidate_matched_preferred_skills"), F.when(k % 3 == 1, True).alias("domain_matches_candidate"),
        F.lit("from facts").alias("job_location"), F.when(k % 2 == 0, "facts apply").otherwise("").alias("direct_apply"))
    score = F.when(k % 6 == 0, nan).when(k % 6 == 1, inf).when(k % 6 == 2, -2.5).when(k % 6 == 3, 7.5).when(k % 6 == 4, -7.49).otherwise(size)
    rows = I.table(spark, sf, "part").select(
        F.lit("u").alias("user_id"), k.alias("ord"), F.lit("l").alias("link"), F.lit("f").alias("fingerprint"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("company_name"), F.when(k % 3 == 1, "").when(k % 3 == 2, F.col("p_type")).alias("location"), none.alias("posted_at"),
        none.alias("salary"), score.alias("score"), F.concat(F.lit("because "), "p_brand").alias("reason"), facts.alias("facts"),
        empty.alias("missing_required"), empty.alias("missing_preferred"), F.when(k % 5 == 0, F.col("p_brand")).alias("apply_url"),
        F.when(k % 7 != 0, F.concat(k.cast("string"), F.lit(" asked"))).otherwise("").alias("applicants_count"), F.lit("s").alias("source"), F.lit("matched").alias("status"))
    return to_ledger_rows(rows).select(
        F.col("ord").alias("p_partkey"), "ai_score", "min_required_yoe", "max_required_yoe", "location", "direct_apply", "applicants_count",
        "domain_matches_candidate", "job_title", "ai_reason", F.array_join("required_skills", "|").alias("required"),
        F.array_join("preferred_skills", "|").alias("preferred"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, coalesce('key/' || l.n, o_orderstatus) AS description_key
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def mapping_swap(spark, sf):
    """The same mapping of all line items, put into a stored table in one step and read back."""
    ledger = VersionedTable(spark, scratch_path(spark, "orders"))
    ledger.replace(I.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("description_key")))
    mapping = I.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(
        F.concat(F.lit("key/"), F.count(F.lit(1)).cast("string")).alias("new_value"))
    ledger.update(lambda rows: set_from_mapping(rows, mapping, "id", "description_key"))
    return ledger.read()


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'already_done' ELSE 'upload' END AS export_status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def export_pending(spark, sf):
    rows = I.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("user_id"))
    done = I.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return export_status(rows, done).select(F.col("id").alias("doc_id"), "export_status")


@query("""
SELECT export_status, count(*) AS n FROM (
  SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'already_done' ELSE 'upload' END AS export_status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY export_status""")
def export_progress(spark, sf):
    rows = I.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("user_id"))
    done = I.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return export_status(rows, done).groupBy("export_status").agg(F.count(F.lit(1)).alias("n"))


GONE_SQL = "SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0"


@query(I.with_(I.SCORED_SQL, I.RUNS_SQL, f"gone(user_id) AS ({GONE_SQL})") + """
SELECT 'jobs' AS child, user_id, count(*) AS n FROM scored WHERE user_id NOT IN (SELECT user_id FROM gone) GROUP BY ALL
UNION ALL
SELECT 'runs' AS child, user_id, count(*) AS n FROM runs WHERE user_id NOT IN (SELECT user_id FROM gone) GROUP BY ALL""")
def cascade_delete_users(spark, sf):
    gone = I.table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").cast("string").alias("user_id"))
    left = cascade_delete({"jobs": (I.scored(spark, sf), "user_id"), "runs": (I.runs(spark, sf), "user_id")}, gone)
    parts = [f.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("child"), "user_id", "n") for name, f in left.items()]
    return parts[0].unionByName(parts[1])


@query("""
SELECT lower(printf('%08x', 0)) || '-0000-0000-0000-' || lpad(lower(to_hex(c_custkey)), 12, '0') AS id,
  CAST(c_nationkey AS DOUBLE) AS amount, c_name AS name, 0.0::DOUBLE AS billed, NULL::VARCHAR AS domain
FROM customer""")
def migrate_ids(spark, sf):
    rows = I.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    return migrate(rows, [
        ("hex_id", "c_custkey"), ("rename", "c_custkey", "id"), ("cast", "c_nationkey", "double"),
        ("rename", "c_nationkey", "amount"), ("rename", "c_name", "name"), ("drop", "c_mktsegment"),
        ("add", "billed", "double", 0.0), ("add", "domain", "string", None)])


@query(I.with_(I.POSTINGS_SQL) + """
SELECT ord, title, description_text AS text, 'Pune' AS location, seniority_level AS seniority,
  'Full-time' AS employment, CASE WHEN ord % 4 = 0 THEN 'f' || ord END AS job_function, CASE WHEN ord % 3 = 0 THEN source END AS industries,
  CASE WHEN ord % 5 = 0 THEN '₹' || ord END AS salary, CASE WHEN ord % 2 = 0 THEN '["' || source || '","x"]' ELSE '[]' END AS benefits,
  CASE WHEN ord % 6 = 0 THEN ord || '+ years' END AS extracted_yoe, 10 AS n_fields FROM postings""")
def extraction_payloads(spark, sf):
    """All a model sees of a posting, read back from its JSON; nulls are written."""
    k = F.col("ord")
    rows = I.postings(spark, sf).withColumns({
        "extracted_yoe_text": F.when(k % 6 == 0, F.concat(k, F.lit("+ years"))), "job_function": F.when(k % 4 == 0, F.concat(F.lit("f"), k)),
        "industries": F.when(k % 3 == 0, F.col("source")), "salary": F.when(k % 5 == 0, F.concat(F.lit("₹"), k)),
        "benefits": F.when(k % 2 == 0, F.array("source", F.lit("x"))).otherwise(F.array().cast("array<string>"))})
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    names = {"title": "title", "text": "descriptionText", "location": "location", "seniority": "seniorityLevel",
             "employment": "employmentType", "job_function": "jobFunction", "industries": "industries", "salary": "salary",
             "benefits": "benefits", "extracted_yoe": "extracted_yoe"}
    return extraction_payload(rows).select("ord", *(field(f).alias(n) for n, f in names.items()),
                                           F.size(F.json_object_keys("payload")).alias("n_fields"))


@query(I.with_(I.POSTINGS_SQL) + """
SELECT p.ord, CASE WHEN l.quality = 1 THEN description_text END AS description_text,
  CASE WHEN l.quality IS NOT NULL THEN 'Resume of ' || p.user_id END AS resume_text
FROM postings p LEFT JOIN labels l ON l.doc_id = p.ord""")
def tailoring_inputs(spark, sf):
    """Description and resume texts looked up by their object keys; missing objects give null."""
    rows = I.postings(spark, sf)
    labels = I.table(spark, sf, "labels").withColumnRenamed("doc_id", "ord")
    key = lambda folder: F.concat(F.lit(f"{folder}/"), F.col("ord").cast("string"), F.lit(".txt"))
    marked = rows.join(labels, "ord", "left")
    descriptions = marked.filter(F.col("quality") == 1).select(
        key("job-descriptions").alias("key"), F.col("description_text").alias("text"))
    resumes = labels.join(rows.select("ord", "user_id"), "ord").select(
        key("user-resumes").alias("key"), F.concat(F.lit("Resume of "), "user_id").alias("text"))
    keyed = rows.select("ord", key("job-descriptions").alias("description_key"), key("user-resumes").alias("resume_key"))
    out = attach_texts(keyed, descriptions, "description_key", "description_text")
    return attach_texts(out, resumes, "resume_key", "resume_text").select("ord", "description_text", "resume_text")


# --- text ---------------------------------------------------------------------------------------------

YOE_PATTERN = r"(?i)((?-i:\bup\s+to\s*)?)(\d+)(?:\s*\+|\s*[–\-]\s*(\d+))?\s*years?\b"
MENTIONS_SQL = f"""mentions AS (
  SELECT k, i, m, regexp_extract(m, '{YOE_PATTERN}', 1) AS prefix,
    TRY_CAST(regexp_extract(m, '{YOE_PATTERN}', 2) AS DOUBLE) AS a,
    nullif(TRY_CAST(regexp_extract(m, '{YOE_PATTERN}', 3) AS DOUBLE), 0) AS b
  FROM (SELECT k, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
    SELECT k, regexp_extract_all(regexp_replace(txt, '(?i)\\byear''?s\\b', 'year', 'g'), '{YOE_PATTERN}', 0) AS ms
    FROM texts))),
bounds AS (
  SELECT k, i, length(prefix) BETWEEN 1 AND 15 AS up, substr(m, length(prefix) + 1) AS txt,
    CASE WHEN NOT up THEN least(a, coalesce(b, a)) END AS lo,
    CASE WHEN up THEN a WHEN b IS NOT NULL THEN greatest(a, b) END AS hi
  FROM mentions),
folded AS (
  SELECT *, max(hi) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM bounds),
yoe AS (
  SELECT k, max(lo) AS yoe_min, max(hi) AS yoe_max,
    arg_max(txt, i) FILTER (WHERE NOT up OR before IS NULL OR hi > before) AS yoe_text
  FROM folded GROUP BY k)"""
PART_TEXT_SQL = f"""texts AS (
  SELECT p_partkey AS k, {I.yoe_sentence_sql('p_partkey')} || ' ' || {I.yoe_sentence_sql('p_size')} AS txt FROM part)"""


@query(I.with_(PART_TEXT_SQL, MENTIONS_SQL) + """
SELECT t.k AS p_partkey, yoe_min, yoe_max, yoe_text,
  CASE WHEN yoe_min IS NOT NULL AND yoe_max IS NOT NULL THEN CAST(yoe_min AS BIGINT) || '-' || CAST(yoe_max AS BIGINT) || ' years'
    WHEN yoe_min IS NOT NULL THEN CAST(yoe_min AS BIGINT) || '+ years'
    WHEN yoe_max IS NOT NULL THEN '0-' || CAST(yoe_max AS BIGINT) || ' years' ELSE 'Not specified' END AS label,
  CASE WHEN yoe_min IS NOT NULL AND yoe_max IS NOT NULL THEN CAST(yoe_min AS BIGINT) || '-' || CAST(yoe_max AS BIGINT) || ' YOE'
    WHEN yoe_min IS NOT NULL THEN CAST(yoe_min AS BIGINT) || ' YOE' ELSE '' END AS short_label
FROM texts t LEFT JOIN yoe ON yoe.k = t.k""")
def yoe_extract(spark, sf):
    p = I.table(spark, sf, "part")
    text = F.concat(I.yoe_sentence(F.col("p_partkey")), F.lit(" "), I.yoe_sentence(F.col("p_size")))
    y = p.select("p_partkey", extract_yoe(text).alias("y"))
    return y.select(
        "p_partkey", F.col("y.min").alias("yoe_min"), F.col("y.max").alias("yoe_max"),
        F.col("y.text").alias("yoe_text"), yoe_label("y.min", "y.max").alias("label"),
        yoe_short_label("y.min", "y.max").alias("short_label"))


URL_SQL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)"
LINK_BODY = f"""
  SELECT page_id, u, regexp_extract(u, '{URL_SQL}', 1) AS s, lower(regexp_extract(u, '{URL_SQL}', 2)) AS h,
    coalesce(nullif(regexp_extract(u, '{URL_SQL}', 4), ''), '/') AS p,
    regexp_extract(u, '[?&]currentJobId=([^&#]*)', 1) AS q FROM urls"""


@query(f"""
WITH urls AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '/en/', '/view/')
    WHEN 2 THEN upper(split_part(url, '.', 1)) || '.Example.com:8080/x?currentJobId=' || page_id
    ELSE split_part(url, '://', 2) END AS u FROM pages),
parts AS ({LINK_BODY})
SELECT page_id, CASE WHEN NOT regexp_matches(u, '{URL_SQL}') THEN u
  WHEN regexp_extract(p, '/view/([0-9]+)', 1) <> '' THEN 'https://www.linkedin.com/jobs/view/' || regexp_extract(p, '/view/([0-9]+)', 1)
  WHEN q <> '' THEN 'https://www.linkedin.com/jobs/view/' || q
  ELSE lower(s) || '://' || h || p END AS link FROM parts""")
def link_normalize(spark, sf):
    k = F.col("page_id")
    raw = (
        F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, F.replace("url", F.lit("/en/"), F.lit("/view/")))
        .when(k % 4 == 2, F.concat(F.upper(F.split_part("url", F.lit("."), F.lit(1))),
                                   F.lit(".Example.com:8080/x?currentJobId="), k.cast("string")))
        .otherwise(F.split_part("url", F.lit("://"), F.lit(2))))
    return I.table(spark, sf, "pages").select("page_id", normalize_link(raw).alias("link"))


@query("""
SELECT page_id, CASE WHEN contains(url, 'example.net') THEN 'Naukri' WHEN contains(url, 'm.') THEN 'Indeed'
  ELSE 'LinkedIn' END AS label,
  CASE WHEN regexp_matches(html, '(?i)bengaluru|bangalore|hyderabad|mumbai|pune|chennai|delhi|gurugram|noida|kolkata|ahmedabad|india')
    THEN 'https://www.simplyhired.co.in' ELSE 'https://www.simplyhired.com' END AS region,
  CASE page_id % 4 WHEN 0 THEN 'r' || ((page_id % 48) * 3600) WHEN 1 THEN 'r604800' WHEN 2 THEN 'r7' ELSE '' END AS code,
  greatest(1, CAST(ceil(page_id / 24.0) AS BIGINT)) AS days
FROM pages""")
def source_region_lookback(spark, sf):
    from siftwell.functions.links import lookback_days

    k = F.col("page_id")
    source = F.when(F.contains("url", F.lit("example.net")), "Naukri").when(
        F.contains("url", F.lit("m.")), "INDEED").otherwise("")
    code = (F.when(k % 4 == 0, F.concat((k % 48).cast("string"), F.lit("hr"))).when(k % 4 == 1, " Past Week ")
            .when(k % 4 == 2, "r7").otherwise("whenever"))
    return I.table(spark, sf, "pages").select(
        "page_id", source_label(source, F.lit("")).alias("label"), region_of("html").alias("region"),
        lookback_code(code).alias("code"), lookback_days(k).alias("days"))


@query("""
SELECT doc_id, regexp_matches(text || ' ' || CASE doc_id % 3 WHEN 0 THEN 'for Freshers' WHEN 1 THEN 'fresh-graduates' ELSE 'refreshers' END,
  '(?i)\\b(?:freshers?|fresh[ -]?graduat(?:es?|ion))\\b') AS fresher FROM documents""".replace("\\\\", "\\"))
def fresher_signal(spark, sf):
    k = F.col("doc_id")
    tail = F.when(k % 3 == 0, "for Freshers").when(k % 3 == 1, "fresh-graduates").otherwise("refreshers")
    return I.table(spark, sf, "documents").select(
        "doc_id", fresher_friendly(F.concat("text", F.lit(" "), tail)).alias("fresher"))
