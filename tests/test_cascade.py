"""The cascade: one user per exit stage, the funnel identity, batch run and stream."""

import json
import time
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.operators.inference import FatalModelError, call_model, parse_facts
from siftwell.plans.batch_run import run_batch
from siftwell.plans.cascade import (
    CARRY, audit_rows, classify, funnel, stage_postings, with_texts,
)
from siftwell.plans.digest import digest_headers
from siftwell.sources.landing import read_raw_batches, stream_raw_batches, users_with_files
from siftwell.operators.ledger import purge
from siftwell.streaming.ingest import start_ingest, stored_ledger

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the model functions below go to workers
NOW = datetime(2024, 2, 1)
LONG = "An ordinary text about work. " * 12


def posting(title="Engineer", company="Acme", link="https://x.org/view/1", text=LONG, date="2024-01-30", **more):
    return {"title": title, "companyName": company, "link": link, "descriptionText": text, "postedAt": date, **more}


def user(uid, years=2.0, excludes=(), active=True, **more):
    row = {f.name: None for f in schemas.USERS.fields}
    row |= {"id": uid, "email": f"{uid}@x.org", "tier": "free", "experience_years": years, "is_active": active,
            "exclude_title_keywords": list(excludes), "known_skills": ["Java"], "chat_id": f"c{uid}", "total_runs_count": 0}
    return row | more


CASES = {  # user: (landed postings, exit stage)
    "blocked": ([posting(company="ScoutIt Ltd")], "blocked_companies"),
    "short": ([posting(text="too short"), posting(title="")], "batch_dedup"),
    "known": ([posting(title="Seen before")], "db_dedup"),
    "stale": ([posting(date="2023-01-01")], "keyword_filter"),
    "words": ([posting(title="PHP dev")], "keyword_filter"),
    "years": ([posting(text=LONG + "9+ years")], "yoe_filter"),
    "senior": ([posting(title="Director")], "seniority_filter"),
    "good": ([posting(), posting(link="https://x.org/view/2"), posting(title="Other", link="https://x.org/view/3"), posting(title="PHP lead"),
              posting(company="scoutit")], "ai_evaluation"),
    "idle": ([posting()], None),
}


def land(root, cases, number=None):
    for name, postings in cases.items():
        folder = root / "raw-jobs" / name
        folder.mkdir(parents=True, exist_ok=True)
        body = {"platform": "linkedin", "keyword": "k", "location": "l", "scrapedAt": "2024-01-31T10:00:00.000Z",
                "count": len(postings), "jobs": postings}
        (folder / f"linkedin-{len(list(folder.iterdir())) if number is None else number}.json").write_text(json.dumps(body, indent=2))


def model(context, items):
    out = []
    for item in items:
        skills = ["Java"] if item["title"] == "Engineer" else ["Rust"]
        known = [s for s in skills if s in context["known_skills"]]
        out.append({"id": item["id"], "required_skills": skills, "candidate_matched_required_skills": known,
                    "job_location": "Pune"})
    return {"results": out, "usage": {"cache_miss_tokens": 10 * len(items), "cost_usd": 0.5 * len(items)}}


@pytest.fixture
def landed(spark, tmp_path):
    land(tmp_path, {k: v[0] for k, v in CASES.items()})
    (tmp_path / "raw-jobs" / "broken").mkdir()
    (tmp_path / "raw-jobs" / "broken" / "linkedin-0.json").write_text("{not json")
    (tmp_path / "raw-jobs" / "bare").mkdir()
    (tmp_path / "raw-jobs" / "bare" / "linkedin-0.json").write_text(json.dumps([posting()]))
    rows = [user(k, excludes=["php"], active=k != "idle") for k in CASES]
    users = spark.createDataFrame(rows, schemas.USERS)
    return tmp_path, users


def known_ledger(spark, postings):
    from siftwell.operators.dedup import with_keys

    rows = with_keys(postings.filter(F.col("user_id") == "known"))
    filled = [F.col({"job_link": "link"}.get(f.name, f.name)).cast(f.dataType).alias(f.name)
              if f.name in ("user_id", "fingerprint", "job_link") else F.lit(None).cast(f.dataType).alias(f.name)
              for f in schemas.LEDGER.fields]
    return rows.select(*filled).withColumn("id", F.lit("old"))


def test_landing(spark, landed):
    path, _ = landed
    rows = read_raw_batches(spark, str(path / "raw-jobs"))
    assert rows.count() == sum(len(v[0]) for v in CASES.values())
    assert {r.user_id for r in users_with_files(spark, str(path / "raw-jobs")).collect()} == {*CASES, "broken", "bare"}


def test_exit_stages_and_identity(spark, landed):
    path, users = landed
    postings = read_raw_batches(spark, str(path / "raw-jobs"))
    staged = stage_postings(classify(postings, users, F.lit(NOW)), known_ledger(spark, postings), ["title"])
    counts = funnel(staged)
    runs = {r.user_id: r for r in audit_rows(counts, None, F.lit(NOW)).collect()}
    assert {u: r.exit_stage for u, r in runs.items()} == {u: s for u, (_, s) in CASES.items() if s}
    for r in counts.collect():
        parts = sum(r[c] for c in r.asDict() if c not in ("user_id", "scraped"))
        assert r.scraped == parts
    good = next(r for r in counts.collect() if r.user_id == "good")
    assert (good.scraped, good.blocked, good.duplicates, good.keyword, good.evaluated) == (5, 1, 1, 1, 2)
    assert runs["years"].keyword_filtered_count == 1 and runs["senior"].keyword_filtered_count == 1
    assert runs["short"].batch_dedup_count == 2


def test_first_copy_decides_even_when_a_later_one_would_pass(spark):
    rows = [("u", 1, "l", "T", "C", LONG, "", "2023-01-01"), ("u", 2, "l", "T", "C", LONG, "", "2024-01-31")]
    df = spark.createDataFrame(rows, "user_id string, ord long, link string, title string, company_name string, "
                                     "description_text string, seniority_level string, posted_at string")
    users = spark.createDataFrame([user("u")], schemas.USERS)
    staged = stage_postings(classify(df, users, F.lit(NOW)), spark.createDataFrame([], schemas.LEDGER))
    assert [(r.stage, r.copies) for r in staged.collect()] == [("outdated", 2)]


def test_staging_hashes_and_moves_no_texts(spark):
    rows = [("u", 7 - i, f"l{i}", f"T{i % 3}", "C", LONG, "Executive" if i % 2 else "", "2024-01-31") for i in range(8)]
    df = spark.createDataFrame(rows, "user_id string, ord long, link string, title string, company_name string, "
                                     "description_text string, seniority_level string, posted_at string")
    users, none = spark.createDataFrame([user("u")], schemas.USERS), spark.createDataFrame([], schemas.LEDGER)
    classed = classify(df, users, F.lit(NOW))
    light, wide = stage_postings(classed, none), stage_postings(classed, none, ["title"])
    key = ["user_id", "fingerprint", "copies", "stage", "ord"]
    assert sorted(map(tuple, light.select(key).collect())) == sorted(map(tuple, wide.select(key).collect()))
    text = light._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "HashAggregate" in text
    assert not [line for line in text.splitlines() if "HashAggregate(" in line and "description_text" in line and "partial" not in line]
    structs = classify(df.withColumn("ord", F.struct(F.lit("f").alias("file"), F.col("ord").alias("pos"))), users, F.lit(NOW))
    assert sorted((r.copies, r.stage, r.ord.pos) for r in stage_postings(structs, none).collect()) == sorted((r.copies, r.stage, r.ord) for r in light.collect())
    chosen = light.where("stage = 'evaluate'")
    wanted = {(r.user_id, r.ord): r.title for r in wide.where("stage = 'evaluate'").collect()}
    postings = df.withColumns({c: F.lit(None).cast("string") for c in CARRY if c not in df.columns and c not in ("benefits", "extracted_yoe_text")}) \
        .withColumn("benefits", F.array().cast("array<string>"))
    assert {(r.user_id, r.ord): r.title for r in with_texts(chosen, postings).collect()} == wanted


def test_postings_cross_one_exchange_and_no_python(spark, landed):
    path, users = landed
    postings = read_raw_batches(spark, str(path / "raw-jobs"))
    plan = stage_postings(classify(postings, users, F.lit(NOW)), spark.createDataFrame([], schemas.LEDGER))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "ArrowEval" not in text
    assert text.count("Exchange hashpartitioning(user_id") <= 2  # postings once, ledger keys once


def test_batch_run(spark, landed):
    path, users = landed
    postings = read_raw_batches(spark, str(path / "raw-jobs"))
    users = users.unionByName(spark.createDataFrame([user("broken"), user("bare", active=False)], schemas.USERS))
    result = run_batch(postings, users, known_ledger(spark, postings), model, F.lit(NOW), parallelism=2,
                       present=users_with_files(spark, str(path / "raw-jobs")))
    rows = {(r.user_id, r.title): r for r in result.evaluated.collect()}
    assert {k: r.status for k, r in rows.items()} == {("good", "Engineer"): "matched", ("good", "Other"): "rejected"}
    assert all(r.ledger_id for r in rows.values())
    inserted = {r.job_title: r for r in result.inserted.collect()}
    assert inserted["Engineer"].ai_score == 10 and inserted["Other"].ai_reason == "0/1 required skills matched; missing: Rust."
    assert inserted["Engineer"].location == "Pune" and inserted["Engineer"].job_link.endswith("/view/1")
    runs = {r.user_id: r for r in result.runs.collect()}
    assert (runs["good"].matched_jobs_count, runs["good"].rejected_jobs_count, runs["good"].actual_cost_usd) == (1, 1, 1.0)
    assert runs["good"].input_tokens == 20 and not {"idle", "bare"} & set(runs)
    assert (runs["broken"].scraped_jobs_count, runs["broken"].exit_stage) == (0, "blocked_companies")
    assert [r.key for r in result.descriptions.collect()] == [f"job-descriptions/good/{rows['good', 'Engineer'].ledger_id}.txt"]
    heads = {r.user_id: r for r in digest_headers(result.runs, users).collect()}
    assert "Final Matches Found:</b> <b>1</b>" in heads["good"].header and "01 Feb 2024, 05:30 am IST" in heads["good"].header
    assert "Want 2 more alerts" in heads["good"].upgrade and "Want more job alerts" in heads["words"].upgrade
    again = run_batch(postings, users, result.inserted.select([f.name for f in schemas.LEDGER.fields]), model, F.lit(NOW))
    assert again.inserted.filter("user_id = 'good'").count() == 0


def test_stream_equals_batch_and_restarts_cleanly(spark, landed):
    path, users = landed
    raw, table, runs, state = (str(path / p) for p in ("raw-jobs", "ledger", "runs", "state"))

    def drain():
        start_ingest(stream_raw_batches(spark, raw, max_files=4), lambda: users, table, runs, state, model,
                     now=lambda: F.lit(NOW)).awaitTermination()
        return stored_ledger(spark, table)

    first = {(r.user_id, r.job_title, r.id) for r in drain().collect()}
    batch = run_batch(read_raw_batches(spark, raw), users, spark.createDataFrame([], schemas.LEDGER), model, F.lit(NOW))
    assert first == {(r.user_id, r.job_title, r.id) for r in batch.inserted.collect()}
    assert drain().count() == len(first)
    land(path, {"good": [posting(), posting(company="New Co", link="https://x.org/view/8")]})
    second = drain()
    assert second.count() == len(first) + 1
    audit = spark.read.parquet(runs).filter("user_id = 'good'").orderBy(F.col("batch_id").desc()).head()
    assert (audit.db_dedup_count, audit.matched_jobs_count, audit.outcome) == (1, 1, "done")


def test_consumed_files_go_and_silent_users_are_audited(spark, landed):
    path, users = landed
    users = users.unionByName(spark.createDataFrame([user("broken"), user("bare", active=False)], schemas.USERS))
    raw, table, runs, state = (str(path / p) for p in ("raw-jobs", "ledger", "runs", "state"))
    files = lambda: sorted(f"{p.parent.name}/{p.name}" for p in (path / "raw-jobs").rglob("*.json"))

    def drain():
        start_ingest(stream_raw_batches(spark, raw, delete=True), lambda: users, table, runs, state, model,
                     now=lambda: F.lit(NOW)).awaitTermination()
        return stored_ledger(spark, table).count()

    landed_files, first = files(), drain()
    audit = {r.user_id: r for r in spark.read.parquet(runs).collect()}
    assert (audit["broken"].scraped_jobs_count, audit["broken"].exit_stage) == (0, "blocked_companies") and "bare" not in audit
    land(path, {"good": [posting(company="New Co", link="https://x.org/view/8")]}, 10)
    new = set(files()) - set(landed_files)
    assert drain() == first + 1
    land(path, {"good": [posting(company="Newer Co", link="https://x.org/view/9")]}, 11)
    assert drain() == first + 2
    gone = set(landed_files) | new
    assert not gone & set(files()) and drain() == first + 2


def test_failed_batch_leaves_audit_rows(spark, landed):
    path, users = landed

    def fatal(context, items):
        raise FatalModelError("no key")

    query = start_ingest(stream_raw_batches(spark, str(path / "raw-jobs")), lambda: users, str(path / "l"), str(path / "r"),
                         str(path / "s"), fatal, now=lambda: F.lit(NOW))
    with pytest.raises(Exception):
        query.awaitTermination()
    audit = spark.read.parquet(str(path / "r"))
    assert {(r.status, r.exit_stage, r.outcome) for r in audit.collect()} == {("FAILED", "catch_error", "failed")}
    assert all("no key" in r.error_message or len(r.error_message) == 1024 for r in audit.collect())


def test_many_calls_are_under_way_and_answers_find_their_rows(spark):
    def slow(context, items):
        import threading
        import time

        time.sleep(0.15 + 0.01 * (items[0]["n"] % 7))
        return {"results": [{"id": i["id"], "job_domain": f"d{i['n']}", "threads": threading.active_count()} for i in reversed(items)]}

    df = spark.createDataFrame([(f"u{i % 3}", i, json.dumps({"n": i}), "x" * 10) for i in range(250)], "user_id string, ord long, payload string, extra string")
    out = call_model(df, slow, "payload", parallelism=1, batch_size=1)
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    start = time.time()
    rows = out.select("ord", "extra", F.get_json_object("model_json", "$.job_domain").alias("d"),
                      F.get_json_object("model_json", "$.threads").cast("int").alias("t")).collect()
    assert sorted((r.ord, r.d) for r in rows) == [(i, f"d{i}") for i in range(250)]
    assert max(r.t for r in rows) >= 25 and time.time() - start < 250 * 0.18 / 3


def test_a_call_that_fails_once_is_tried_again(spark, tmp_path):
    mark = str(tmp_path / "failed")

    def once(context, items):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("busy")
        return {"results": [{"id": i["id"], "size": len(items)} for i in items]}

    df = spark.createDataFrame([("u", i, "{}") for i in range(4)], "user_id string, ord long, payload string")
    sizes = [r.s for r in call_model(df, once, "payload", parallelism=1, pause=0.01).select(F.get_json_object("model_json", "$.size").alias("s")).collect()]
    assert sizes == ["4"] * 4


def test_model_fallbacks(spark):
    def flaky(context, items):
        if len(items) > 1:
            raise RuntimeError("batch too big")
        n = items[0]["n"]
        if n == 1:
            raise RuntimeError("bad row")
        return {"results": [] if n == 2 else [{"id": items[0]["id"], "job_domain": f"d{n}"}], "usage": {"completion_tokens": n}}

    df = spark.createDataFrame([("u", i, json.dumps({"n": i})) for i in range(5)], "user_id string, ord long, payload string")
    out = call_model(df, flaky, "payload", parallelism=1).select("ord", parse_facts("model_json").alias("f"), "completion_tokens")
    got = {r.ord: (r.f.job_domain, r.completion_tokens) for r in out.collect()}
    assert got == {0: ("d0", 0), 1: (None, 0), 2: (None, 2), 3: ("d3", 3), 4: ("d4", 4)}


@pytest.mark.parametrize("text, want", [
    (None, (None, None, [], False)), ("{", (None, None, [], False)), ("[]", (None, None, [], False)),
    ('{"job_domain": 5, "min_required_yoe": "3+ yrs", "required_skills": ["a", "b"], "domain_matches_candidate": true}',
     (None, 3.0, ["a", "b"], True)),
    ('{"job_domain": "x", "min_required_yoe": 2.5, "required_skills": ["a", 1], "domain_matches_candidate": "true"}',
     ("x", 2.5, [], False)),
    ('{"min_required_yoe": "none", "required_skills": "a"}', (None, None, [], False)),
    ('{"min_required_yoe": true, "required_skills": []}', (None, 1.0, [], False)),
    ('{"min_required_yoe": [1], "required_skills": null}', (None, None, [], False)),
])
def test_facts_degrade_per_field(one, text, want):
    f = one(parse_facts("t"), "t string", t=text)
    assert (f["job_domain"], f["min_required_yoe"], f["required_skills"], f["domain_matches_candidate"]) == want
    assert f["preferred_skills"] == [] and f["direct_apply"] is None


def test_stream_leaves_all_tables(spark, landed):
    path, users = landed
    raw, table, runs = (str(path / p) for p in ("raw-jobs", "ledger", "runs"))

    def drain(name, now):
        start_ingest(stream_raw_batches(spark, raw), lambda: users, table, runs, str(path / name), model,
                     now=lambda: F.lit(now), tables=str(path / "tables"), app_url="https://app").awaitTermination()
        return {t: spark.read.parquet(str(path / "tables" / t)) for t in ("descriptions", "digest", "posts", "user_counters")}

    left = drain("one", NOW)
    rows = {r.job_title: r for r in stored_ledger(spark, table).filter("user_id = 'good'").collect()}
    objects = left["descriptions"].filter("user_id = 'good'").collect()
    assert [o.key for o in objects] == [rows["Engineer"].description_key] and rows["Other"].description_key is None
    digest = left["digest"].filter("user_id = 'good'").collect()
    assert [(d.rank, d.ledger_id) for d in digest] == [(1, rows["Engineer"].id)] and "[ #1 ] — Engineer" in digest[0].card
    assert left["posts"].count() == spark.read.parquet(str(path / "tables/digest")).join(
        users.filter("credentials.accessToken <> '' AND credentials.personUrn <> ''").select(F.col("id").alias("user_id")), "user_id").count()
    assert {r.runs for r in left["user_counters"].collect()} == {1}


def test_purge_keeps_rows_without_a_time(spark):
    rows = spark.createDataFrame([("a", None), ("b", NOW), ("c", NOW.replace(year=2000))], "id string, created_at timestamp")
    kept, removed = purge(rows, F.lit(NOW))
    assert sorted(r.id for r in kept.collect()) == ["a", "b"] and removed.head().removed == 1
