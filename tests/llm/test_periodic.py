"""Periodic runs against a plain search over all stretches."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) of all runs, from all lags and all stretches of them."""
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                out.setdefault((i - q, j), q)  # smaller periods come first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def numbers(text):
    return np.array([ord(c) for c in text], np.int64)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_a_plain_search(letters):
    random.seed(letters)
    for _ in range(300):
        text = "".join(random.choice("abcdefgh"[:letters]) for _ in range(random.randrange(1, 60)))
        for _ in range(random.randrange(3)):
            at = random.randrange(len(text))
            text += text[at:at + random.randrange(1, 30)] * random.randrange(1, 5)
        got = [(s, e - s, q) for s, e, q in periodic.runs_of(numbers(text))]
        assert got == plain_runs(text), text


def test_runs_of_fibonacci_words_and_nested_periods():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    nested = (("aab" * 9 + "c") * 5 + "d") * 4
    for text in (b, nested, "a" * 13 + "b" + "a" * 12, ("a" * 40 + "b") * 30, "ab" * 6, "ab" * 5 + "a"):
        assert [(s, e - s, q) for s, e, q in periodic.runs_of(numbers(text))] == plain_runs(text), text[:40]


def test_texts_side_by_side_do_not_touch():
    words = [f"w{i}".encode() for i in range(9)]
    assert periodic.in_texts([words, words, words[:0], words * 2, words]) == [[], [], [], [(0, 18, 9)], []]


def test_very_long_texts_cost_in_proportion():
    random.seed(3)
    for words in ([b"a"] * 400_000, [random.choice((b"a", b"b")) for _ in range(200_000)], [b"x", b"y", b"z"] * 100_000):
        start = time.perf_counter()
        runs, = periodic.in_texts([words])
        assert time.perf_counter() - start < 30
        assert len(set(words)) == 2 or runs == [(0, len(words), len(set(words)))]
    words = [str(i).encode() for i in range(30_000)] * 5
    assert periodic.in_texts([words]) == [[(0, 150_000, 30_000)]]


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect())
    assert got == sorted(plain(*d) for d in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (None, "a b " * 10), (None, "a b " * 10), (11, "é ü " * 8), (3, "x y " * 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit(7)).withColumn("collapsed", F.lit("c"))
    got = periodic.find_runs(docs, keep=["doc_id"]).collect()
    want = {t: [(s, m, q) for s, m, q in plain_runs((t or "").encode().split())] for _, t in rows}
    assert [[tuple(x) for x in r["runs"]] for r in got] == [want[t] for _, t in rows]
    assert [r["collapsed"] for r in got] == ["", "", "", "one", "a b", "a b", "é ü", "x y"]
    assert periodic.find_runs(docs.where("false"), keep=["doc_id"]).count() == 0
    tails = {r["doc_id"]: r["text"] for r in periodic.with_periodic_tails(docs).where("doc_id is not null").collect()}
    assert tails[1] is None and tails[4] == "one"
    ten = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    blank = spark.createDataFrame([(ten, None), (ten, " "), (ten, "a")], "doc_id bigint, text string")
    assert [r["text"] for r in periodic.with_periodic_tails(blank).collect()] == ["", "", "a"]
