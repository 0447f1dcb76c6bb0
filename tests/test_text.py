"""Text, link and experience helpers: one table per rule."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.functions import experience, links, render, text
from siftwell.workload.postings import MENTIONS_SQL


def test_space_class_equals_char_set(values):
    chars = [chr(c) for c in [*range(1, 0x180), *range(0x1670, 0x1690), *range(0x1ff0, 0x2070), 0x3000, 0xfeff, 0xe9]]
    got = values(lambda: F.col("s").rlike(f"^{text.SPACE}$"), chars, "s string")
    assert [c for c, hit in zip(chars, got) if hit] == sorted(text.SPACE_CHARS)


@pytest.mark.parametrize("raw, want", [
    (None, ""), ("", ""), ("<p>a</p><p>b</p>", "a\n\nb"), ("a<br/>b<BR >c", "a\nb\nc"),
    ("<ul><li>x</li><li>y</li></ul>", "x\ny"), ("&amp;lt;b&gt; &quot;q&quot; &#039;s&#039;&nbsp;.", "<b> \"q\" 's' ."),
    ("a\n\n\n\nb", "a\n\nb"), ("a\n \n \nb", "a\n\nb"), ("<div><b>deep</b> <unclosed", "deep <unclosed"),
    ("<script>var t=1</script>", "var t=1"), ("　 x ﻿", "x"),
])
def test_strip_html(one, raw, want):
    assert one(text.strip_html("h"), "h string", h=raw) == want


def test_fingerprint(one):
    got = one(text.fingerprint("t", "c", "d"), "t string, c string, d string", t=" A  B\n", c=None, d="x\t\ty")
    assert got == hashlib.sha256("a b||x y".encode()).hexdigest()


@pytest.mark.parametrize("raw, want", [
    ("https://www.linkedin.com/jobs/view/123?trk=a", "https://www.linkedin.com/jobs/view/123"),
    ("https://Other.org:443/x/view/9/z", "https://www.linkedin.com/jobs/view/9"),
    ("https://x.org/jobs/view/testing-engineer-at-y-4444", "https://x.org/jobs/view/testing-engineer-at-y-4444"),
    ("https://x.org/search?a=1&currentJobId=77&b=2", "https://www.linkedin.com/jobs/view/77"),
    ("https://x.org/search?currentJobId=", "https://x.org/search"),
    ("https://x.org/search?notcurrentJobId=5", "https://x.org/search"),
    ("HTTP://USER@Ex.ORG:8080/P?q#f", "http://ex.org:8080/P"), ("http://ex.org:80", "http://ex.org/"),
    ("not a url", "not a url"), ("", ""), (None, None),
])
def test_normalize_link(one, raw, want):
    assert one(links.normalize_link("u"), "u string", u=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("12hr", "r43200"), ("6h", "r21600"), ("2 hours", ""), ("3hours", "r10800"), ("Past Month", "r2592000"),
    ("r99", "r99"), ("24hr", "r86400"), (None, ""),
])
def test_lookback(one, raw, want):
    assert one(links.lookback_code("u"), "u string", u=raw) == want


def test_rounding_and_numbers(one):
    assert [one(text.round_half_up("v"), v=v) for v in (-2.5, 2.5, 7.49)] == [-2, 3, 7]
    assert one(text.round_half_up("v"), "v double", v=float("nan")) is None
    assert one(text.finite("v"), "v double", v=float("inf")) is None
    assert [one(text.number_text("v"), v=v) for v in (5.0, 2.5)] == ["5", "2.5"]


def test_url_component(one):
    assert one(text.url_component("v"), v="a b&c/é!~*'()-_.") == "a%20b%26c%2F%C3%A9!~*'()-_."


# --- years of experience ------------------------------------------------------------------------

MENTIONS = {  # text: (min, max, shown)
    "2-4 years": (2, 4, "2-4 year"), "5+ years": (5, None, "5+ year"), "up to 3 years and 2 years": (2, 3, "2 year"),
    "Up to 3 years": (3, None, "3 year"), "0–2 years": (0, 2, "0–2 year"), "3 - 0 years": (3, None, "3 - 0 year"),
    "4 year's": (4, None, "4 year"), "10 years, 2-3 years": (10, 3, "2-3 year"), "": (None, None, None),
    "none": (None, None, None), "up to 5-8 years": (None, 5, "5-8 year"),
    "2 years. up to 1 year. up to 9 years": (2, 9, "9 year"), "up to 9 years, up to 4 years": (None, 9, "9 year"),
    "5yearsX": (None, None, None), "5years": (5, None, "5years"), "5year's": (5, None, "5year"),
    "7 YEARS'": (7, None, "7 year"), "up  to 4years": (None, 4, "4years"), "cup to 4 years": (4, None, "4 year"),
    "up to             4 years": (4, None, "4 year"), "12+years 3 - 5 Year": (12, 5, "3 - 5 Year"),
    "fre 5 years’": (5, None, "5 year"), "0 years": (0, None, "0 year"), "1-2-3 years": (2, 3, "2-3 year"),
    "\u00a03\u2003+\u00a0years": (3, None, "3\u2003+\u00a0year"),
}


def test_extract_yoe_cases(values):
    got = values(lambda: experience.extract_yoe("s"), list(MENTIONS), "s string")
    for source, g in zip(MENTIONS, got):
        assert (g["min"], g["max"], g["text"]) == MENTIONS[source], source


def test_extract_yoe_random_texts_equal_sql(values):
    rnd = random.Random(7)
    words = ["up to ", "Up to ", "up\nto", "years", "year", "year's", "Years", " ", "  ", "+", "-", "–", "3", "12", "0", "x",
             "and ", ". ", "cup to "]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    got = values(lambda: experience.extract_yoe("s"), texts, "s string")
    con = duckdb.connect()
    con.register("texts", pd.DataFrame({"k": range(len(texts)), "txt": texts}))
    want = {k: (lo, hi, t) for k, lo, hi, t in con.execute(
        f"WITH {MENTIONS_SQL} SELECT k, yoe_min, yoe_max, yoe_text FROM yoe").fetchall()}
    assert len(want) > 300
    for k, g in enumerate(got):
        assert (g["min"], g["max"], g["text"]) == want.get(k, (None, None, None)), texts[k]


def test_extract_yoe_null(one):
    assert one(experience.extract_yoe("s"), "s string", s=None) == {"min": None, "max": None, "text": None}


def test_fresher(values):
    inputs = ["Freshers welcome", "refresher", "fresh graduates", "fresh-graduation", "freshgraduate", "freshness", "fresh"]
    assert values(lambda: experience.fresher_friendly("s"), inputs, "s string") == [
        True, False, True, True, True, False, False]


def test_yoe_rules(values):
    rows = [(3.0, None, 2, False), (2.0, None, 2, False), (None, 1.0, 2, False), (None, 1.0, 2, True), (5.0, 1.0, 2, True),
            (None, None, 9, False)]
    got = values(lambda: experience.yoe_reject_reason("lo", "hi", "c", "f"), rows, "lo double, hi double, c long, f boolean")
    assert got == [
        "YOE: requires 3+ yr, candidate has 2 yr", None, "YOE: requires 1- yr max, candidate has 2 yr", None,
        "YOE: requires 5+ yr, candidate has 2 yr", None]


# --- templates ------------------------------------------------------------------------------------

@pytest.mark.parametrize("template, want", [
    ("{a}{b}", "X{a}"), ("{{a}}", "{X}"), ("no", "no"), ("{zzz} {a", "{zzz} {a"), ("{a} end ", "X end "), (None, ""),
])
def test_fill_template_is_one_pass(one, template, want):
    got = one(render.fill_template("t", {"a": F.lit("X"), "b": F.lit("{a}")}), "t string", t=template)
    assert got == want
