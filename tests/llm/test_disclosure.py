"""Personal data by plain patterns, revealing terms by plain counts."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwell.llm import disclosure, queries

SF = "/root/testdata/sf0.001"
PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_luhn(number):
    twice = {i: (2 * i) // 10 + (2 * i) % 10 for i in range(10)}
    return sum(twice[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(number))) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            good = [True, all(int(x) <= 255 for x in m.group().split(".")) if kind == 1 else True,
                    13 <= len(number) <= 19 and plain_luhn(number), 9 <= len(number) <= 15][kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def value(kind, match):
    return (kind, match.lower() if kind == 0 else match if kind == 1 else re.sub("[^0-9]", "", match))


def plain_spans(rows, bits, share, support, near=10):
    """Spans of each text by counting all pairs in dictionaries."""
    n = len(rows)
    held, having, both, seen = Counter(), Counter(), Counter(), defaultdict(set)
    seen_entity, found = defaultdict(set), []
    for text in rows:
        text = text or ""
        base = plain_base(text)
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", text)]
        terms = [w.lower().strip(disclosure.EDGES) for _, _, w in words]
        held.update({t for t in terms if t})
        held.update({"\x00" + disclosure.class_of(t, w) for t, (_, _, w) in zip(terms, words) if t})
        touched = [any(s < b and a < e for _, a, b in base) for s, e, _ in words]
        pairs = set()
        for kind, a, b in base:
            inside = [i for i, (s, e, _) in enumerate(words) if s < b and a < e]
            for i in range(max(0, inside[0] - near), min(len(words), inside[-1] + near + 1)):
                if not touched[i] and len(terms[i]) > 1:
                    pairs.add((value(kind, text[a:b]), terms[i]))
        entities = {value(k, text[a:b]) for k, a, b in base}
        having.update(entities)
        both.update(pairs)
        for p in pairs:
            seen[p].add(text)
        for e in entities:
            seen_entity[e].add(text)
        found.append((text, base, words, terms, touched, pairs))
    good = set()
    for (e, t), k in both.items():
        if len(seen[e, t]) >= support and held[t] <= n * 2 ** -bits:
            pmi, worth = math.log2(k * n / (having[e] * held[t])), math.log2(n / having[e])
            if pmi >= bits and pmi >= share * worth:
                good.add((e, t))
    out = []
    for text, base, words, terms, touched, pairs in found:
        revealing = {t for e, t in pairs if (e, t) in good}
        extra = []
        for (s, _, w), t, hit in zip(words, terms, touched):
            if t in revealing and not hit:
                at = s + len(w) - len(w.lstrip(disclosure.EDGES))
                common = held["\x00" + disclosure.class_of(t, w)] > n * 2 ** -bits
                extra.append((4 if common else 5, at, at + len(t)))
        out.append(base + sorted(extra))
    return out


def test_base_spans_equal_the_patterns():
    random.seed(4)
    pieces = ["a@b.c", "@", "x.y+z@d-e.fg.hi", ".", "..", "1.2.3.4", "255.256.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "+1 (743) 555-3824", "+", "+4", "-", " ", "\n", "0", "007", "é", "日", "(", ")", "12", "79927398713", "+999999999", "@b", "b.c", "%"]
    for _ in range(6000):
        text = "".join(random.choice(pieces) for _ in range(random.randrange(1, 12)))
        assert [s[:3] for s in disclosure.base_spans(text)] == plain_base(text), text
    for _ in range(3000):
        text = "".join(random.choice("a@.-+0123 9(") for _ in range(random.randrange(1, 60)))
        assert [s[:3] for s in disclosure.base_spans(text)] == plain_base(text), text


@pytest.mark.parametrize("text", ["a" * 2_000_000, "1" * 2_000_000, "a@" * 500_000, "+" * 1_000_000, "1." * 700_000, "a.b@c.d " * 100_000,
                                  "@a." * 500_000, "+1" + "(" * 1_000_000, "1 " * 800_000])
def test_very_long_texts_cost_in_proportion(text):
    start = time.perf_counter()
    base = disclosure.base_spans(text)
    disclosure.context(text, base[:1000], frozenset())
    assert time.perf_counter() - start < 20


@pytest.fixture(scope="module")
def planted():
    """Texts in which a name, a nickname and a street go with one address, beside words that go with none."""
    random.seed(8)
    plain_words = [f"word{i}" for i in range(60)]

    def prose(n):
        return " ".join(random.choice(plain_words) for _ in range(n))

    rows = [prose(40) for _ in range(2000)]
    for i in range(8):
        rows.append(f"{prose(15)} Ask Quillon, {random.choice(['zorbly', 'frandip'])} of 7b-lane: quillon.x@corp{i % 2}.example.org {prose(20)}")
    rows += [f"{prose(30)} write to u{i}@corp.example.org or call +1 (555) 010-{1000 + i} {prose(9)}" for i in range(30)]
    rows += [rows[2000]] * 4 + [f"Quillon was not here, {prose(12)}", None, "", " \n"]
    return rows


def test_terms_equal_plain_counts(spark, planted):
    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id int, text string") \
        .withColumn("_key", F.lit("k")).withColumn("spans", F.lit(1))
    want = plain_spans(planted, 6.0, 0.8, 3)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in disclosure.examine(docs, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(planted))] == want
    added = [planted[i][s:e] for i, spans in enumerate(want) for k, s, e in spans if k >= 4]
    assert {"Quillon", "7b-lane"} <= set(added) and not any(w.startswith("word") for w in added)
    assert not want[-4]  # a text without an entity has nothing to protect
    assert disclosure.examine(docs.where("false"), ["doc_id"]).count() == 0


def test_sanitised_texts(spark, planted):
    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id int, text string") \
        .withColumn("_key", F.lit("k")).withColumn("_terms", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs).collect()}
    assert disclosure.sanitise(docs).columns == docs.columns and len(got) == len(planted)
    for i, spans in enumerate(plain_spans(planted, 6.0, 0.8, 3)):
        text = planted[i]
        if not spans:
            assert got[i] == text
            continue
        assert not plain_base(got[i]) and "quillon" not in got[i].lower() and "7b-lane" not in got[i]
        assert all(mark in got[i] for mark in ("[email]",))
    assert "[word]" in "".join(t or "" for t in got.values()) or "[name]" in "".join(t or "" for t in got.values())


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = plain_spans([r["text"] for r in docs], disclosure.BITS, disclosure.SHARE, disclosure.SUPPORT)

    def written(spans):
        return ",".join(f"{disclosure.KINDS[k]}:{s}:{e}" for k, s, e in spans)

    rows = []
    for r, spans in zip(docs, want):
        base = [s for s in spans if s[0] < 4]
        rows.append((r["doc_id"], *(sum(s[0] == k for s in base) for k in range(4)),
                     hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
    assert sorted(tuple(r) for r in queries.QUERIES["op11_disclosing_terms"](spark, SF).collect()) == rows
