"""Posting rules, fit table, skills, validation."""

import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell import constants as K
from siftwell.functions.fit import evaluate_fit, skills_missing
from siftwell.operators import rules, skills, validation as V
from siftwell.schemas import FACTS


def test_company_block(values):
    got = values(lambda: rules.company_blocked("c"), ["Scoutit Inc", " SCOUTIT ", "", None, "Other"], "c string")
    assert got == [True, True, False, False, False]


def test_complete(values):
    long = "x" * 300
    rows = [("l", "t", "c", long), ("l", "t", "c", " " + "x" * 299 + " "), ("", "t", "c", long), ("l", None, "c", long),
            ("l", "t", "c", None)]
    got = values(lambda: rules.posting_complete(), rows,
                 "link string, title string, company_name string, description_text string")
    assert got == [True, False, False, False, False]


def test_outdated(values):
    now = F.lit(datetime(2024, 2, 1))
    rows = ["2024-01-18", "2024-01-17T23:59:59Z", "2 days ago", None, "", "2025-01-01", "Jan 5, 2024", "January 25, 2024",
            "5 Jan 2024", "1/5/2024", "Foo 5, 2024", "10:00"]
    assert values(lambda: rules.outdated("p", now), rows, "p string") == [
        False, True, False, False, False, False, True, False, True, True, False, False]


def test_keyword_hits_keep_order_and_trim(one):
    got = one(rules.keyword_hits("t", "s", "k"), "t string, s string, k array<string>",
              t="Lead C++ (Remote)", s="Director", k=["director", " ", "c++ ", "LEAD", "java"])
    assert got == ["director", "c++", "lead"]


def test_seniority(values):
    rows = [("Tech Lead", 2), ("Leadership Coach", 5), ("VP", 3), ("VP Sales", 3), ("Tech Lead", 6), ("SDE II", 6),
            ("Intern", 9), ("Summer Intern 2", 9), (None, 1)]
    got = values(lambda: rules.seniority_keyword("t", "y"), rows, "t string, y long")
    assert got == ["lead", "lead", None, "vp ", None, "sde i", None, "intern ", None]


# --- fit --------------------------------------------------------------------------------------------

# (skills asked, skills had): band of the share
SHARES = {(0, 0): "none", (5, 2): "low", (10, 5): "low", (5, 3): "middle", (10, 6): "middle", (10, 7): "middle",
          (3, 2): "middle", (5, 4): "high", (10, 8): "high", (5, 5): "high", (2, 3): "high"}
DECISION = {  # (required band, preferred band): category
    ("none", "none"): "no_match", ("none", "low"): "no_match", ("none", "middle"): "minor_gaps", ("none", "high"): "strong_match",
    ("low", "none"): "skills_mismatch", ("low", "low"): "skills_mismatch", ("low", "middle"): "skills_mismatch",
    ("low", "high"): "skills_mismatch", ("middle", "none"): "minor_gaps", ("middle", "low"): "minor_gaps",
    ("middle", "middle"): "minor_gaps", ("middle", "high"): "strong_match", ("high", "none"): "strong_match",
    ("high", "low"): "strong_match", ("high", "middle"): "strong_match", ("high", "high"): "strong_match",
}
# stated range: does a candidate of 2.2 years (counted as 3) fit it
RANGES = {(None, None): True, (3.0, None): True, (3.5, None): False, (4.0, 9.0): False, (None, 2.0): False, (None, 3.0): True}


def test_fit_table_over_all_edges(spark):
    rows, want = [], []
    names = [f"s{i}" for i in range(10)]
    for (req, pref), (bounds, fits), domain in itertools.product(
            itertools.product(SHARES, SHARES), RANGES.items(), [True, False]):
        rows.append((len(rows), 2.2, {
            "job_domain": None, "min_required_yoe": bounds[0], "max_required_yoe": bounds[1],
            "required_skills": names[:req[0]], "preferred_skills": names[:pref[0]],
            "candidate_matched_required_skills": names[:req[1]], "candidate_matched_preferred_skills": names[:pref[1]],
            "domain_matches_candidate": domain, "job_location": None, "direct_apply": None}))
        want.append(DECISION[SHARES[req], SHARES[pref]] if fits else "experience_mismatch")
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("experience_years", T.DoubleType()),
                           T.StructField("facts", FACTS)])
    got = evaluate_fit(spark.createDataFrame(rows, schema)).orderBy("i").select("category", "score", "status").collect()
    assert [g["category"] for g in got] == want
    assert all(g["score"] == K.CATEGORY_SCORES[g["category"]] for g in got)
    assert all((g["status"] == "matched") == (g["category"] in K.MATCHED_CATEGORIES) for g in got)


def test_missing_skills_keep_repeats_and_order(one):
    got = one(skills_missing("t", "m"), "t array<string>, m array<string>",
              t=["B", "a  b", "C", "B", "A B"], m=[" a b ", "c"])
    assert got == ["B", "B"]


def test_skill_rules(spark):
    df = spark.createDataFrame(
        [(["Express"], ["JavaScript", "TypeScript", "Node.js"], ["React"]), (["Vue"], ["React", "JavaScript"], ["React", "Angular"]),
         (["TypeScript"], ["javascript "], []), (["JavaScript"], ["TypeScript"], []), (None, ["AWS"], None),
         ([" gcp"], ["AWS", "Azure", "aws"], [])],
        "known_skills array<string>, required_skills array<string>, preferred_skills array<string>")
    got = [(r[3], r[4]) for r in skills.match_skills(df).collect()]
    assert got == [(["JavaScript"], []), ([], ["React", "Angular"]), (["javascript "], []), ([], []), ([], []),
                   (["AWS", "Azure", "aws"], [])]


def test_mentioned_skills(spark):
    df = spark.createDataFrame([("We use Node.js, C and REST. Also (Kafka)!",), (None,)], "text string")
    got = [r.found for r in skills.mention_skills(df, "text", "found").collect()]
    assert got == [["node.js", "rest", "kafka"], []]


# --- validation -------------------------------------------------------------------------------------

REQUEST = ("keyword string, location string, dateSincePosted string, jobType string, experienceLevel string, "
           "remoteFilter string, sortBy string, limit string, page string")


@pytest.mark.parametrize("change, error", [
    ({}, ""), ({"keyword": " "}, 'Either "keyword" or "location"'), ({"dateSincePosted": "12Hours"}, ""),
    ({"dateSincePosted": "r60"}, ""), ({"dateSincePosted": "soon"}, 'Invalid dateSincePosted "soon"'),
    ({"jobType": "Full Time, c"}, ""), ({"jobType": "contract,,"}, 'Invalid jobType ""'),
    ({"limit": "0"}, "Invalid limit"), ({"limit": "2.5"}, "Invalid limit"), ({"limit": "x"}, "Invalid limit"),
    ({"limit": "100"}, ""), ({"page": "-1"}, "Invalid page"), ({"page": "0"}, ""), ({"sortBy": "DD"}, ""),
])
def test_search_request(spark, change, error):
    row = {c.split()[0]: None for c in REQUEST.split(", ")} | {"keyword": "dev"} | change
    df = spark.createDataFrame([tuple(row.values())], REQUEST)
    got = V.with_errors(df, V.search_rules("linkedin"), first_only=True).head()["errors"]
    assert (error in got) if error else got == ""


@pytest.mark.parametrize("platform, row, error", [
    ("naukri", {"keyword": "", "location": "x"}, '"keyword" parameter is required'),
    ("naukri", {"keyword": "a", "experience": "31"}, "Invalid experience"),
    ("naukri", {"keyword": "a", "jobAge": "7", "wfhType": "remote,2"}, ""),
    ("naukri", {"keyword": "a", "jobAge": "8"}, "Invalid jobAge"),
    ("indeed", {"location": "a", "jobType": "FullTime,,"}, ""), ("indeed", {"location": "a", "fromage": "0"}, "Invalid fromage"),
    ("simplyhired", {"keyword": "a", "datePosted": "3Days", "jobType": "cf3cp"}, ""),
    ("simplyhired", {"keyword": "a", "distance": "-2"}, "Invalid distance"),
])
def test_other_platforms(spark, platform, row, error):
    columns = ["keyword", "location", "experience", "jobAge", "sort", "wfhType", "limit", "page", "fromage", "jobType",
               "datePosted", "distance"]
    df = spark.createDataFrame([tuple(row.get(c) for c in columns)], ", ".join(f"{c} string" for c in columns))
    got = V.with_errors(df, V.search_rules(platform), first_only=True).head()["errors"]
    assert (error in got) if error else got == ""


def test_sanitized_requests(spark):
    df = spark.createDataFrame([(" dev ", None, "0", None, "F", "Remote, 2", "7")],
                               "keyword string, location string, limit string, page string, sort string, wfhType string, jobAge string")
    r = V.sanitize_search(df, "naukri").head()
    assert (r.keyword, r.limit, r.page, r.sort, r.wfhType, r.jobAge) == ("dev", 25, 0, "date", ["remote", "2"], 7)
    df = df.withColumn("jobType", F.lit("FullTime,,contract"))
    r = V.sanitize_search(df, "simplyhired").head()
    assert (r.page, r.sort, r.jobType) == (1, "f", ["fulltime", "contract"])


def test_array_valued_request_fields(spark):
    df = spark.createDataFrame([(["remote", "Hybrid"],), (["moon"],), (None,)], "remoteFilter array<string>")
    rule = V.all_of_array("remoteFilter", K.REMOTE_VALUES, lambda v: F.concat(F.lit("bad "), v))
    assert [r.errors for r in V.with_errors(df, [rule]).collect()] == ["", "bad moon", ""]


def test_user_request(spark):
    columns = {c: "string" for c in (
        "email", "name", "phone", "resumeText", "telegramChatId", "linkedinPostTemplate", "tier", "subscriptionExpiresAt",
        "linkedinProfileUrl", "targetLocations", "employmentType", "primaryDomain", "candidateSummary", "source")}
    columns |= {"subscriptionAmount": "double", "experienceYears": "double", "excludeTitleKeywords": "array<string>"}
    base = {"email": "a@b.org", "resumeText": "x" * 60}
    rows = [base, base | {"email": "nope", "tier": "gold"}, {"resumeText": "short"},
            base | {"excludeTitleKeywords": ["ok", " "], "experienceYears": -1.0, "source": "tv"}]
    df = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows],
                               ", ".join(f"{c} {t}" for c, t in columns.items()))
    got = [r.errors for r in V.with_errors(df, V.user_request_rules(create=True)).collect()]
    assert got[0] == ""
    assert got[1] == "email: Must be a valid email address; tier: Invalid option"
    assert got[2] == "email: Required; resumeText: Resume plain text must be at least 50 characters long"
    assert got[3] == ("experienceYears: Experience years must be 0 or greater; excludeTitleKeywords: Keywords must have 1 to "
                      "50 characters; source: Source must be one of: linkedin, whatsapp, other")
    good, bad = V.validate(df, V.user_request_rules(create=True))
    assert (good.count(), bad.count()) == (1, 3)


def test_run_request(spark):
    df = spark.createDataFrame([(12, None), (0, "x"), (200, "01234567-89ab-cdef-0123-456789ABCDEF")],
                               "lookbackHours int, targetUserId string")
    got = [r.errors for r in V.with_errors(df, V.run_request_rules()).collect()]
    assert got == ["", "lookbackHours: Lookback must be at least 1 hour; targetUserId: targetUserId must be a valid UUID",
                   "lookbackHours: Lookback cannot exceed 168 hours (7 days)"]
