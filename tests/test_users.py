"""Users, clicks, reports, pages of postings, tasks, queue."""

from datetime import datetime

from pyspark.sql import functions as F

from siftwell.operators import clicks, queue, users as U
from siftwell.plans import dashboard, reports, search_tasks as S
from siftwell.schemas import USERS
from test_cascade import user

NOW = datetime(2024, 2, 1)


def test_downgrade(spark):
    past, future = datetime(2024, 1, 1), datetime(2025, 1, 1)
    rows = [user("a", tier="premium", subscription_expires_at=past, subscription_amount=499.0),
            user("b", tier="premium", subscription_expires_at=future), user("c", tier="premium"),
            user("d", tier="premium", subscription_expires_at=past, active=False), user("e", tier="free", subscription_expires_at=past)]
    after, changed = U.downgrade_expired(spark.createDataFrame(rows, USERS), F.lit(NOW))
    assert {r.id: r.tier for r in after.collect()} == {"a": "free", "b": "premium", "c": "premium", "d": "premium", "e": "free"}
    row = after.filter("id = 'a'").head()
    assert row.subscription_expires_at is None and row.updated_at == NOW
    assert after.filter("id = 'e'").head().subscription_expires_at == past
    note = changed.collect()
    assert [r.id for r in note] == ["a"] and "₹499/month" in note[0].notice
    assert U.downgrade_expired(spark.createDataFrame(rows, USERS), F.lit(NOW), "zzz")[1].count() == 0


def test_change_feed(spark):
    old = spark.createDataFrame([user("a", name="Ann", years=1.0), user("b")], USERS)
    t = lambda d: datetime(2024, 1, d)
    feed = spark.createDataFrame(
        [("a", "update", t(1), "Anna", None, None), ("a", "update", t(3), None, 4.0, None), ("a", "update", t(2), "Annie", 3.0, False),
         ("n", "create", t(1), "New", None, None), ("n", "update", t(2), "Newer", None, None), ("x", "update", t(1), "Ghost", None, None)],
        "id string, op string, ts timestamp, name string, experience_years double, is_active boolean")
    got = {r.id: r for r in U.apply_user_changes(old, feed, F.lit(NOW)).collect()}
    assert sorted(got) == ["a", "b", "n"]
    assert (got["a"].name, got["a"].experience_years, got["a"].is_active, got["a"].updated_at) == ("Annie", 4.0, False, NOW)
    assert got["b"].updated_at is None and got["a"].email == "a@x.org"
    n = got["n"]
    assert (n.name, n.tier, n.is_active, n.total_runs_count, n.exclude_title_keywords) == ("Newer", "premium", True, 0, [])
    assert n.subscription_expires_at == datetime(2024, 2, 8) and n.created_at == NOW


def test_resolve(spark):
    people = spark.createDataFrame([user("u1")], USERS)
    ids = ["01234567-89AB-cdef-0123-456789abcdef", " U1@X.org ", "nobody", ""]
    req = spark.createDataFrame([(i, s) for i, s in enumerate(ids)], "i int, identifier string")
    got = [r.user_id for r in U.resolve_users(req, people).orderBy("i").collect()]
    assert got == [ids[0], "u1", None, None]


def test_clicks(spark):
    rows = [(None, "u", "Telegram", "APPLY"), ("j1", None, "telegram", "apply"), ("j1", "v", "dashboard", "resume"),
            ("j9", None, "telegram", "apply"), (None, None, "telegram", "apply"), (None, "u", "mail", "apply"),
            (None, "u", "", "apply"), ("j1", "", "dashboard", "apply")]
    df = spark.createDataFrame(rows, "jobId string, userId string, source string, type string")
    ledger = spark.createDataFrame([("j1", "u")], "id string, user_id string")
    counters = clicks.click_counters(clicks.click_counts(df, ledger))
    got = {r.user_id: (r.telegram_apply_clicks, r.telegram_resume_clicks, r.dashboard_apply_clicks, r.dashboard_resume_clicks)
           for r in counters.collect()}
    assert got == {"u": (2, 0, 1, 0), "v": (0, 0, 0, 1)}
    people = spark.createDataFrame([user("u", telegram_apply_clicks=5, telegram_resume_clicks=0, dashboard_apply_clicks=0,
                                         dashboard_resume_clicks=0)], USERS)
    assert clicks.add_clicks_to_users(people, counters).head().telegram_apply_clicks == 7


def test_reports(spark):
    people = spark.createDataFrame([user("a", tier="premium", subscription_amount=100.0), user("b", subscription_amount=9.0)], USERS)
    runs = spark.createDataFrame(
        [("a", datetime(2024, 1, 31, 20), "SUCCESS", 0.0), ("a", datetime(2024, 1, 31, 10), "SUCCESS", 2.0), ("b", NOW, "FAILED", 1.5)],
        "user_id string, run_at timestamp, status string, actual_cost_usd double")
    total = reports.run_totals(runs, people).head()
    assert (total.total_runs, total.successful_runs, total.mrr, total.total_profit_usd) == (3, 2, 100.0, 96.5)
    months = reports.monthly_breakdown(runs, people).collect()
    assert [(r.month, r.runs_count, r.net_profit_usd) for r in months] == [("2024-02", 1, 98.5), ("2024-01", 2, 98.0)]
    days = reports.daily_breakdown(runs, F.lit(NOW).cast("date")).collect()
    assert [(r.day, r.runs_count, r.min_cost_usd, r.max_cost_usd) for r in days] == [
        ("2024-02-01", 2, 1.5, 1.5), ("2024-01-31", 1, 2.0, 2.0)]
    usage = spark.createDataFrame([("u", 0, 0), ("v", 1, 3)], "u string, cache_hit_tokens long, cache_miss_tokens long")
    assert {r.u: r.cache_hit_pct for r in reports.cache_hit_rate(usage, ["u"]).collect()} == {"u": 0.0, "v": 25.0}
    costs = spark.createDataFrame([(1_000_000, 2_000_000, 3, 10)], "cache_hit_tokens long, cache_miss_tokens long, "
                                  "completion_tokens long, scraped_jobs_count long")
    c = reports.run_cost(costs).head()
    assert (c.model_cost_usd, c.scrape_cost_usd, c.total_cost_usd) == (0.294001, 0.01, 0.304001)


def test_pages_of_postings(spark):
    rows = [(f"i{n}", "u" if n % 4 else "v", n % 12 if n % 12 else None, datetime(2024, 1, 1 + n % 20, 23, 59)) for n in range(60)]
    df = spark.createDataFrame(rows, "id string, user_id string, ai_score int, created_at timestamp")
    everyone = spark.createDataFrame([user("u"), user("v")], USERS)

    def want(uid, page, limit, score):
        mine = [r for r in rows if r[1] == uid and (score <= 0 or (r[2] is not None and r[2] >= score))]
        mine.sort(key=lambda r: (r[2] is not None, -(r[2] or 0), r[3], r[0]))
        return [r[0] for r in mine[(page - 1) * limit:page * limit]], len(mine)

    for page, limit, score in ((1, 5, 6), (2, 4, 6), (1, 7, 0), (99, 5, 6), (300, 5, 6), (1, 1001, 0)):
        all_rows = dashboard.all_pages(df, everyone, page, limit, score=score).collect()
        for uid in ("u", "v"):
            ids, total = want(uid, page, limit, score)
            assert [r.id for r in dashboard.user_page(df, uid, page, limit, score=score).collect()] == ids
            mine = sorted((r for r in all_rows if r.user_id == uid), key=lambda r: r.position)
            assert [r.id for r in mine] == ids and all(r.total == total for r in mine)
    inside = dashboard.date_range(df, until=F.lit("2024-01-05").cast("date"))
    assert {r.created_at.day for r in inside.collect()} == {1, 2, 3, 4, 5}


def test_search_tasks(spark):
    people = spark.createDataFrame(
        [("a", 0, ["Dev ", "QA"], "Pune, , GOA"), ("b", 1, ["dev"], " pune"), ("c", 2, None, "Pune"),
         ("d", 3, [f"t{i}" for i in range(7)], None)],
        "id string, ord long, suggested_job_titles array<string>, target_locations string")
    asked = S.user_queries(people, order="ord")
    tasks = {(r.platform, r.task_key): r for r in S.search_tasks(asked).collect()}
    pune = tasks["linkedin", "dev:pune"]
    assert (pune.keyword, pune.location, pune.geo_id, pune.n_users) == ("Dev ", "pune", "114806696", 2)
    assert tasks["linkedin", "qa:goa"].geo_id is None and tasks["naukri", "dev:india"].n_users == 2
    assert sum(1 for k in tasks if k[1].startswith("t")) == 5 * 9 + 5
    lists = S.task_user_lists(S.task_members(asked), size=1, block=1).filter("platform = 'naukri' and task_key = 'dev:india'")
    assert [(r.part, r.user_ids) for r in lists.orderBy("part").collect()] == [(1, ["a"]), (2, ["b"])]
    batches = S.task_batches(S.search_tasks(asked), block=2).filter("platform = 'naukri'").orderBy("task_no").collect()
    assert [r.batch_no for r in batches] == [1, 1, 1, 2, 2, 2, 3]
    assert batches[0].task_key == "dev:india"
    out = {r.platform: r for r in S.dispatch_options(S.search_tasks(asked), 30).collect()}
    assert out["linkedin"].date_since_posted == "30hr" and out["naukri"].job_age == 2


def test_search_tasks_sort_no_queries(spark):
    """The first spelling by creation, id and position, as sorting all queries gives it, but without that."""
    times = [None, "2024-01-02 00:00:00", "2024-01-01 00:00:00.000001", "2024-01-01 00:00:00"]
    rows = [(str(i * 7 % 40), i, times[0 if i > 30 and i % 7 == 0 else 1 + i % 3], [("dev", "Dev ", " DEV")[i % 3], f"T{i % 6}", f"t{i % 6}"],
             (None, "Pune,goa", "Goa")[i % 3]) for i in range(40)]
    people = spark.createDataFrame(rows, "id string, ord long, at string, suggested_job_titles array<string>, target_locations string") \
        .withColumn("created_at", F.col("at").cast("timestamp"))
    for order, before in (("ord", "HashAggregate"), ("created_at", "BroadcastHashJoin")):
        asked = S.user_queries(people, order=order)
        groups = {}
        for r in asked.collect():
            at = (r.user_ord,) if order == "ord" else (r.user_ord.created_at is not None, str(r.user_ord.created_at), r.user_ord.id)
            groups.setdefault((r.platform, r.task_key), []).append((at, r.keyword_pos, r.place_pos, r.keyword, r.location, r.user_ord))
        tasks = S.search_tasks(asked)
        got = {(r.platform, r.task_key): (r.keyword, r.location, r.n_users, r.first_at) for r in tasks.collect()}
        assert got == {k: (min(g)[3], min(g)[4], len(g), (min(g)[5], *min(g)[1:3])) for k, g in groups.items()}
        # of the steps above the queries, the one that makes them few comes before any that sorts
        plan = tasks._jdf.queryExecution().sparkPlan().toString().splitlines()
        steps = [name for line in plan for name in ("HashAggregate", "SortAggregate", "BroadcastHashJoin") if name in line]
        assert [s for s in steps if s != "BroadcastHashJoin" or order != "ord"][-1] == before


def test_queue(spark):
    can = {"accessToken": "t", "refreshToken": None, "personUrn": "p"}
    people = spark.createDataFrame([user("a", credentials=can, post_template="Job {title}", phone="1"), user("b")], USERS)
    rows = [("a", 1, "Dev", "Acme", "l1"), ("b", 2, "QA", None, "l2")]
    matched = spark.createDataFrame(rows, "user_id string, ord long, title string, company_name string, link string")
    for c, t in {"ai_job_location": "string", "location": "string", "required_skills": "array<string>",
                 "preferred_skills": "array<string>", "min_required_yoe": "double", "max_required_yoe": "double",
                 "employment_type": "string", "seniority_level": "string", "salary": "string", "direct_apply": "string"}.items():
        matched = matched.withColumn(c, F.lit(None).cast(t))
    sent = queue.build_post_messages(matched, people)
    assert [r.user_id for r in sent.collect()] == ["a"]
    odd = spark.createDataFrame([("z", 3, '{"platform":"x","userId":"z","job":{"title":"T"}}'), ("b", 4, '{"userId":"b","job":{}}'),
                                 ("a", 5, "garbage")], "user_id string, ord long, message string")
    got = {r.user_id: (r.status, r.post) for r in queue.post_status(
        queue.read_messages(sent.unionByName(odd)), people).collect()}
    assert got == {"a": ("ready", "Job Dev"), "z": ("unknown_user", None), "b": ("no_credentials", None)}
