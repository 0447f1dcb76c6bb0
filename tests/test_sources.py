"""Pages, texts, logs, fan-out."""

import gzip
import json

from pyspark.sql import functions as F

from siftwell.sources import landing, logs, pages, tables


def page(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id int, html string")


def test_linkedin_cards(spark):
    html = """<ul>
      <li data-entity-urn="urn:1"><h3 class="base-search-card__title"> Dev <b>&amp; Ops</b> </h3>
        <h4 class="x base-search-card__subtitle"><a href="#">Acme</a></h4><span class="job-search-card__location"> Pune </span>
        <span class="job-search-card__salary-info">1
           - 2</span><time class="job-search-card__listdate" datetime="2024-01-02">1 day ago</time>
        <a class="base-card__full-link" href="https://x/jobs/view/555?x=1"></a></li>
      <li><h3 class="base-search-card__title">NoCompany</h3></li>
      <LI><h3 class="base-search-card__title">B</h3><h4 class="base-search-card__subtitle">C</h4>
        <a href="https://x/jobs/b-at-c-123456789" class="base-card__full-link"></a></LI></ul>"""
    got = pages.pages_to_items(page(spark, html, "<p>nothing</p>")).orderBy("pos").collect()
    assert [(r.id, r.position, r.company, r.location, r.salary, r.date, r.agoTime) for r in got] == [
        ("urn:1", "Dev & Ops", "Acme", "Pune", "1 - 2", "2024-01-02", "1 day ago"),
        ("123456789", "B", "C", "", "Not specified", "", "")]
    assert got[0].jobUrl == "https://x/jobs/view/555?x=1"


def test_naukri_cards(spark):
    card = '<div class="srp-jobtuple-wrapper"><a class="title" href="{h}">{t}</a><a class="comp-name" title="{c}">short</a>' \
           '<span class="locWdth">Pune</span><span class="sal">9 L</span><span class="job-post-day">Today</span></div>'
    html = card.format(h="/job-1", t="Dev", c="Acme Ltd") + card.format(h="https://n/2", t="", c="X")
    wrapped = ('<div class="srp-jobtuple-wrapper"><a class="title" href="https://n/3">Ops</a><span class="x comp-dtls-wrap">'
               '<a href="/c">Beta <i>Co</i></a></span></div>')
    assert pages.pages_to_items(page(spark, wrapped), "naukri").head().company == "Beta Co"
    got = pages.pages_to_items(page(spark, html), "naukri").collect()
    assert [(r.position, r.company, r.jobUrl, r.salary, r.source) for r in got] == [
        ("Dev", "Acme Ltd", "https://www.naukri.com/job-1", "9 L", "naukri")]


def test_indeed_cards(spark):
    html = ('<div class="job_seen_beacon"><h2 class="jobTitle"><a data-jk="k1" class="jcs-JobTitle" id="job_k1" href="/rc?x">Dev</a></h2>'
            '<span data-testid="company-name">Acme</span><div data-testid="text-location">Goa</div></div>'
            '<div class="job_seen_beacon"><h2 class="jobTitle">no key</h2></div>')
    got = pages.pages_to_items(page(spark, html), "indeed").collect()
    assert [(r.id, r.position, r.company, r.location, r.salary) for r in got] == [("k1", "Dev", "Acme", "Goa", "Not specified")]


def test_cards_with_tags_nested_in_tags_of_their_name(spark):
    linkedin = ('<ul><li data-entity-urn="u"><div class="base-search-card__title"><div>Dev</div> <div>Ops</div></div>'
                '<ul><li>perk<li>other perk</ul><div class="base-search-card__subtitle">Ac<div>me</div></div></li></ul>')
    naukri = ('<div class="srp-jobtuple-wrapper"><div class="title"><div>Lead</div> Dev<br>Ops</div><div class="comp-dtls-wrap"><div><div></div>'
              '<a>Beta</a></div></div></div><div class="srp-jobtuple-wrapper"><div class="comp-dtls-wrap"><a>NoTitle</a></div></div>')
    indeed = ('<div class="job_seen_beacon"><div><div class="companyName"><div>X</div>&amp;Y</div></div><a class="jcs-JobTitle" id="job_7">T</a></div>'
              '<a data-jk="out">outside</a></div></p><img src=x><div class="cardOutline"><a data-jk=k9 href=/q>U')
    rows = {site: [(r.id, r.position, r.company, r.salary) for r in pages.pages_to_items(page(spark, html, None, ""), site).orderBy("pos").collect()]
            for site, html in (("linkedin", linkedin), ("naukri", naukri), ("indeed", indeed))}
    assert rows == {"linkedin": [("u", "Dev Ops", "Acme", "Not specified")], "naukri": [("", "Lead DevOps", "Beta", "Not specified")],
                    "indeed": [("7", "T", "X&Y", "Not specified"), ("k9", "", "", "Not specified")]}


def test_selectors():
    from siftwell.sources import markup

    (card,) = markup.cards_of('<section><p class="a b">1</p><div class="w"><p><b class="a">2</b></p></div><i data-k="v">3</i></section>', ("section",))
    assert card.text(".a") == "1" and card.text("b.a") == "2" and card.text(".w p .a") == "2" and card.text("[data-k=v]") == "3"
    assert card.text(".zz", "i") == "3" and card.text("i.a") == "" and card.attribute("class", "p") == "a b" and card.first(".a .w") is None
    assert card.text("i", ".a") == "1"  # the first in the document, whichever selector names it


def test_criteria_last_value_wins(spark):
    item = '<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">{}</h3>' \
           '<span class="a description__job-criteria-text">\n {} </span></li>'
    html = item.format("Seniority level", "Mid") + item.format("Industries", "") + item.format("Seniority level", "Senior")
    r = pages.page_details(page(spark, html + '<div class="show-more-less-html__markup">Long <b>text</b></div>')).head()
    assert r.criteria == {"Seniority level": "Senior"} and r.seniority_level == "Senior"
    assert (r.industries, r.description_text, r.applicants_count) == ("", "Long text", "")


def test_embedded_json(spark):
    def wrap(text):
        return f'<html><script id="__NEXT_DATA__" type="application/json">{text}</script></html>'

    jobs = [{"jobKey": "a", "title": "T", "company": "C", "salaryInfo": "5L", "encodedUrl": "/j%20x+y", "dateOnIndeed": "d"},
            {"jobKey": "b", "title": "U", "salaryInfo": {"raw": "9L", "min": 1}}, {"jobKey": "c", "salaryInfo": {"min": 2}}]
    view = {"jobDescriptionHtml": "<p>Hi</p>", "employerName": "Boss", "jobTypes": ["Full", "Part"], "compensation": {"raw": "7L"}}
    good = wrap(json.dumps({"props": {"pageProps": {"jobs": jobs, "viewJobData": view, "pageCursors": {"2": "x"}}}}))
    empty = wrap(json.dumps({"props": {"pageProps": {"jobs": []}}}))
    frame = page(spark, good, wrap('{"props": {'), "<html></html>", empty)
    got = pages.pages_embedded_json(frame, F.lit("https://b")).orderBy("pos").collect()
    assert [(r.id, r.company, r.salary, r.jobUrl) for r in got] == [
        ("a", "Boss", "5L", "https://b/j x+y"), ("b", "", "9L", ""), ("c", "", "Not specified", "")]
    assert got[0].details.descriptionText == "Hi" and got[0].details.employmentType == "Full, Part"
    assert got[1].details is None and got[0].page_cursors == {"2": "x"}


def test_blocked_pages(spark):
    df = spark.createDataFrame([("<title>Just a moment...</title>", "http://a"), ("<title>Jobs</title>", "http://a/Captcha"),
                                ("<title>Jobs</title>", None)], "html string, url string")
    assert [r.hit for r in df.select(pages.page_blocked().alias("hit")).collect()] == [True, True, False]
    assert pages.drop_blocked_pages(df, url=None).count() == 2


def test_texts_by_key(spark, tmp_path):
    (tmp_path / "t" / "u").mkdir(parents=True)
    (tmp_path / "t" / "u" / "a.txt").write_text("line 1\nline 2")
    texts = tables.read_texts(spark, f"file:{tmp_path}/t")
    rows = spark.createDataFrame([("u/a.txt",), ("u/b.txt",), (None,)], "key string")
    got = {r.key: r.text for r in tables.attach_texts(rows, texts, "key", "text").collect()}
    assert got == {"u/a.txt": "line 1\nline 2", "u/b.txt": None, None: None}


def test_log_digest_reads_gzip(spark, tmp_path):
    batch = {"logGroup": "g", "logEvents": [{"timestamp": 0, "message": '{"message": "boom", "level": "ERROR"}'},
                                            {"timestamp": 1500, "message": "plain"}, {"timestamp": 2, "message": '{"message": ""}'}]}
    (tmp_path / "x.json.gz").write_bytes(gzip.compress(json.dumps(batch).encode()))
    r = logs.log_digest(logs.read_log_batches(spark, str(tmp_path))).head()
    assert r.subject == "[ERROR] g"
    assert r.digest.split(logs.SEPARATOR) == [
        "[g]\n1970-01-01T00:00:00.000Z\nboom", "[g]\n1970-01-01T00:00:01.500Z\nplain", '[g]\n1970-01-01T00:00:00.002Z\n{"message": ""}']


def test_fan_out(spark, tmp_path):
    members = spark.createDataFrame([("t1", f"u{i}") for i in range(30)] + [("t2", "u1"), ("t3", "u9")], "task_key string, user_id string")
    posts = spark.createDataFrame(
        [("t1", "linkedin", 1), ("t1", "linkedin", 2), ("t2", "naukri", 3), ("t4", "naukri", 4)], "task_key string, platform string, n int")
    want = sorted([(f"u{i}", n) for i in range(30) for n in (1, 2)] + [("u1", 3)])
    assert sorted((r.user_id, r.n) for r in landing.fan_out(posts, members).collect()) == want
    jobs = posts.select("task_key", "platform", F.lit("k").alias("keyword"), F.lit("l").alias("location"),
                        F.struct(F.col("n").cast("string").alias("id"), F.lit("x").alias("position")).alias("job"))
    landing.write_fan_out(jobs, members, str(tmp_path), F.lit("2024-01-01 10:00:00").cast("timestamp"), jobs_per_file=1)
    back = landing.read_raw_batches(spark, str(tmp_path)).collect()
    assert sorted((r.user_id, int(r.id)) for r in back) == want
    assert {(r.platform, r.title, r.keyword) for r in back} == {("linkedin", "x", "k"), ("naukri", "x", "k")}


def test_fan_out_counts_make_no_copies(spark):
    members = spark.createDataFrame([("t1", f"u{i}") for i in range(30)] + [("t2", "u1"), ("t3", "u9")], "task_key string, user_id string")
    posts = spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 3), ("t4", 4)], "task_key string, n int")
    want = sorted([(f"u{i}", 2) for i in range(30) if i != 1] + [("u1", 3)])
    assert sorted((r.user_id, r.copies) for r in landing.fan_out_counts(posts, members).collect()) == want
    # ten thousand million copies
    many = spark.range(100_000).select(F.lit("t").alias("task_key"), F.col("id").alias("user_id"))
    got = landing.fan_out_counts(many.select("task_key"), many).agg(F.count("*").alias("users"), F.sum("copies").alias("copies")).head()
    assert (got.users, got.copies) == (100_000, 10_000_000_000)


def test_site_cards_of_titles_cut_inside_a_reference(spark, tmp_path):
    import duckdb

    from siftwell.workload.pages import site_cards
    from siftwell.workload import SQL

    titles = ["A &amp;&amp", "B &lt;b&gt; &amp;lt; &copy; &copy", "C & D", "&amp", "plain"]
    rows = [(i, f"https://h{i}.org/x", f"<html><title>{t}</title><body><article>x</article></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = site_cards(spark, str(tmp_path))
    want = con.execute(SQL["site_cards"])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())


def test_widen_leaves_big_scans_alone(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "one"))
    small = spark.read.parquet(str(tmp_path / "one"))
    assert tables.widen(small, "id").rdd.getNumPartitions() == 8
    many = spark.range(0, 100, numPartitions=9)
    assert tables.widen(many, "id").rdd.getNumPartitions() == 9
