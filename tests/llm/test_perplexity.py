"""The n-gram model and its bands against plain counting."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import quality
from siftwell.llm.quality import ORDER


def plain_model(texts):
    """p(gram) of modified Kneser-Ney by dictionaries; a function of n-grams of ORDER characters."""
    counts = {ORDER: Counter()}
    for t in texts:
        padded = "\n" * (ORDER - 1) + t
        counts[ORDER].update(padded[i:i + ORDER] for i in range(len(t)))
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, total, left = {}, {}, {}
    for k, level in counts.items():
        t = [max(1, sum(n == j for n in level.values())) for j in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        d = [min(most, max(0.05, x)) for x, most in zip(
            (1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]), (0.95, 1.95, 2.95))]
        off[k], total[k], left[k] = d, Counter(), defaultdict(float)
        for g, n in level.items():
            total[k][g[:-1]] += n
            left[k][g[:-1]] += d[min(n, 3) - 1]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / len(counts[1])
        below = p(gram[1:])
        n, c = counts[k][gram], total[k][gram[:-1]]
        if not c:
            return below
        return (n - off[k][min(n, 3) - 1] if n else 0) / c + left[k][gram[:-1]] / c * below

    return p


def word(rng, letters):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(2, 8)))


@pytest.fixture(scope="module")
def corpus():
    """Two languages of invented words with word order, and odd rows."""
    rng, rows = random.Random(2), []
    for lang, letters in (("xx", "abcdefgh"), ("yy", "mnopqé日r")):
        words = [word(rng, letters) for _ in range(200)]
        follows = {w: rng.sample(words, 12) for w in words}
        for i in range(150):
            at, text = rng.choice(words), []
            for _ in range(rng.randrange(60, 200)):
                text.append(at)
                at = rng.choice(follows[at])
            rows.append((len(rows), " ".join(text) + ".", lang))
    rows += [(900, None, "xx"), (901, "", None), (902, "one", None), (903, rows[0][1], "xx"), (903, rows[0][1], "xx"), (None, "zz " * 70, "zz")]
    return rows


@pytest.fixture(scope="module")
def table(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id int, text string, lang string")


def test_perplexity_equals_plain_counting(spark, corpus, table):
    models = {lang: plain_model([t or "" for _, t, x in corpus if x == lang]) for lang in {r[2] for r in corpus}}
    got = {(r["doc_id"], r["lang"]): r for r in quality.judge(table.repartition(3)).collect()}
    for i, text, lang in corpus:
        text, padded = text or "", "\n" * (ORDER - 1) + (text or "")
        logs = [math.log(models[lang](padded[k:k + ORDER])) for k in range(len(text))]
        r = got[i, lang]
        assert (r["log_perplexity"] is None) == (not text)
        if text:
            assert r["log_perplexity"] == pytest.approx(-np.mean(logs), rel=1e-4)
            assert r["word_log_perplexity"] == pytest.approx(-sum(logs) / len(text.split()), rel=1e-4)


def test_model_sums_to_one_and_knows_what_to_do_with_unseen_grams(spark, corpus):
    plain = [t for _, t, lang in corpus if lang == "xx" and t]
    counts = Counter()
    for t in plain:
        padded = "\n" * (ORDER - 1) + t
        counts.update(padded[i:i + ORDER] for i in range(len(t)))
    model = quality.Model(spark.createDataFrame([("lxx", g, n) for g, n in counts.items()], "lang string, gram string, n bigint"))
    letters = sorted({g[-1] for g in counts})
    contexts = [next(iter(counts))[:-1], "\n\n\n\n", "hhhh", "abab", "Z?Z?"]
    asked = spark.createDataFrame([("lxx", c + x) for c in contexts for x in letters] + [("lno", "aaaaa")], "lang string, gram string")
    got = {(r["lang"], r["gram"]): r["p"] for r in model.of(asked).collect()}
    for c in contexts:
        assert sum(got["lxx", c + x] for x in letters) == pytest.approx(1, abs=1e-9)
    p = plain_model(plain)
    assert all(got["lxx", c + x] == pytest.approx(p(c + x), rel=1e-9) for c in contexts for x in letters) and got["lno", "aaaaa"] is None


def test_model_grows_with_the_input(spark, table):
    few, all_ = (quality.task_counts(t).select("lang", "gram").distinct().count() for t in (table.where("doc_id < 20"), table))
    assert all_ > 2 * few


def test_junk_is_rejected_in_each_language(spark, corpus, table):
    rng = random.Random(3)
    junk = []
    for i in range(40):
        _, text, lang = corpus[rng.randrange(300)]
        shuffled = list(text)
        rng.shuffle(shuffled)
        junk.append((2000 + i, ["".join(shuffled), " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in text.split()),
                                " | ".join(text.split()), " ".join(word(rng, "stuvwxyz") for _ in range(90))][i % 4], lang))
    got = quality.judge(table.unionAll(spark.createDataFrame(junk, table.schema)))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert sum(kept[i] for i, _, _ in junk) <= 0.1 * len(junk)
    assert sum(kept[i] for i in range(300)) >= 0.97 * 300
    # each verdict from the medians and spreads of its language, by hand
    rows = [r for r in got.collect() if not r["base_failed"]]
    for r in rows:
        want = True
        for m in quality.MEASURES:
            own = sorted((x[m], x["n_words"]) for x in rows if x["lang"] == r["lang"])
            middle = own[(len(own) - 1) // 2][0]
            far = sorted(abs(v - middle) * math.sqrt(n) for v, n in own)
            unit = 1.4826 * far[(len(far) - 1) // 2] / math.sqrt(r["n_words"])
            want &= abs(r[m] - middle) <= max(quality.ABOVE * unit, quality.LEAST * middle)
        assert r["kept"] == want


def test_long_texts_and_small_chunks_give_the_same(spark, table, monkeypatch):
    rows = [(1, "ab cd " * 3000, "xx"), (2, "x" * 5000, "xx"), (3, None, "xx")]
    want = list(quality.chunks([t or "" for _, t, _ in rows]))
    assert len(want) == 1
    monkeypatch.setattr(quality, "CHUNK", 700)
    parts = list(quality.chunks([t or "" for _, t, _ in rows]))
    assert len(parts) > 5
    for a, b in ((np.concatenate([quality.hashes(c)[s] for c, s, _ in x]), np.concatenate([o for _, _, o in x])) for x in (want, parts)):
        first = (a, b) if "first" not in locals() else first
        assert (first[0] == a).all() and (first[1] == b).all()


def test_other_documents_than_counted_are_told(spark, table):
    folder, _ = quality.fit(table.where("doc_id < 10"))
    with pytest.raises(Exception, match="store the documents first"):
        quality.measure(table, folder, ["doc_id"]).collect()


def test_kept_rows_keep_their_columns(spark, table):
    odd = table.withColumn("kept", F.lit(7)).withColumn("_lang", F.lit("x")).withColumn("n_words", F.lit("y"))
    verdict = {(r["doc_id"], r["text"]) for r in quality.judge(table).join(table.select("doc_id", "text"), "doc_id").where("kept").collect()}
    got = quality.keep_good(odd)
    assert got.columns == odd.columns and {(r["doc_id"], r["text"]) for r in got.collect()} == verdict
    assert quality.keep_good(odd.where("false")).count() == 0
