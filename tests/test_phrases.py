"""Names of long lists in texts, by both forms, against plain tests."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import phrases, rules, skills


@pytest.fixture(scope="module")
def lists(spark):
    rnd = random.Random(4)
    syllables = ["ka", "lo", "mi", "ne", "pu", "ra", "so", "te"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(400)]
    names = [" ".join(rnd.choice(words).title() for _ in range(rnd.randrange(1, 3))) for _ in range(300)] + ["", None, " ", "C++", "c++", ".Net", "a"]
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", ",", ".", "!"]) for _ in range(rnd.randrange(0, 30))) for _ in range(200)]
    texts += [None, "", "We use C++, .NET and a lot.", "X" * 50]
    return (spark.createDataFrame([(n,) for n in names], "name string"), names,
            spark.createDataFrame(list(enumerate(texts)), "id int, text string"), texts)


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
@pytest.mark.parametrize("whole", [True, False])
def test_both_forms_equal_plain_contains(spark, lists, most_bytes, whole):
    table, names, docs, _ = lists
    plain = {r.id: r.p for r in docs.select("id", (phrases.plain_words("text") if whole else F.lower(F.coalesce("text", F.lit("")))).alias("p")).collect()}
    got = {r.id: r.found for r in phrases.find_names(docs, "text", table, whole_words=whole, most_bytes=most_bytes).collect()}
    assert len(got) == len(plain)
    for i, p in plain.items():
        want = {n for n in names if n and n.strip() and (f" {n.lower().strip()} " if whole else n.lower().strip()) in p}
        assert got[i] == sorted(want), i


def test_same_as_the_short_list_operators(spark, lists):
    table, names, docs, _ = lists
    short = sorted({n.lower() for n in names if n and n.strip()})
    words = spark.createDataFrame([(n,) for n in short], "name string")
    want = {r.id: sorted(r.found) for r in skills.mention_skills(docs, "text", "found", short).collect()}
    assert {r.id: r.found for r in phrases.find_names(docs, "text", words).collect()} == want
    companies = docs.withColumnRenamed("text", "company_name")
    want = {r.id: r.blocked for r in rules.company_block(companies, short).collect()}
    for most in (1 << 20, 0):
        assert {r.id: r.blocked for r in phrases.block_listed(companies, words, most_bytes=most).collect()} == want


def test_fifty_thousand_names_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    own = docs.select(F.explode(F.split(phrases.plain_words("text"), " ")).alias("name")).where("name <> ''").distinct().orderBy("name").limit(20_000)
    names = own.unionAll(spark.range(50_000).select(F.concat(F.lit("name"), "id")))
    found = phrases.find_names(docs, "text", names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    listed = {r.name for r in names.collect()}
    for r in found.select("doc_id", "found", phrases.plain_words("text").alias("p")).collect():
        assert r.found == sorted(set(r.p.split(" ")) & listed)


def test_empty_lists(spark, lists):
    _, _, docs, texts = lists
    none = spark.createDataFrame([], "name string")
    for most in (1 << 20, -1):
        assert phrases.find_names(docs, "text", none, most_bytes=most).where("size(found) > 0").count() == 0
