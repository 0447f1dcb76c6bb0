"""Live secrets by owner: many documents, exact copies and long tokens of one owner; tokens of several owners."""

from pyspark.sql import functions as F

from siftwell.llm import secrets

WORD = "Zx9Qw8Er7Ty6Ui5Op4As3"
LONG = WORD * 40


def rows_of(spark):
    rows = [(i, f"note {i} key {WORD}a", "o1") for i in range(6)]
    rows += [(10 + i, f"copied key {WORD}b", "o2") for i in range(4)]
    rows += [(20, f"long {LONG}", "o3")]
    rows += [(30 + i, f"example {i} {WORD}c", f"o{i}") for i in range(2)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_one_owner_is_enough(spark):
    rows, df = rows_of(spark)
    got = {r["doc_id"]: r["spans"] for r in secrets.find(df, F.col("doc_id"), F.col("source")).collect()}
    masked = {r["doc_id"]: r["text"] for r in secrets.mask(df, F.col("doc_id"), F.col("source")).collect()}
    for i, text, _ in rows:
        start = text.index(WORD)
        assert got[i] == ("" if i >= 30 else f"live:{start}:{len(text)}"), i
        assert masked[i] == (text if i >= 30 else text[:start] + "[SECRET]"), i


def test_several_owners_need_few_repositories(spark):
    _, df = rows_of(spark)
    find = lambda most: {r["doc_id"]: r["spans"] for r in secrets.find(
        df, F.col("doc_id"), F.col("source"), most_repositories=most, most_owners=2).collect()}
    assert find(2)[30].startswith("live") and find(1)[30] == "" and find(1)[10].startswith("live")
