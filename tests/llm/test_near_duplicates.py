"""The pipeline's near-duplicate stage against all pairs of planted texts."""

import random
import re

from pyspark.sql import functions as F

from siftwell.llm import jaccard, simhash, stages
from siftwell.session import shared_folder


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_parts(rows):
    sets, part = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j]):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    return part


def planted():
    """Chains of changed copies, copies of one text, a passage that many hold, repeated and missing doc_ids."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passage, rows, at = words(30), [], 0
    for size in (12, 40, 90, 200, 600):
        for _ in range(6):
            text = words(size)
            for _ in range(rng.randrange(1, 6)):
                rows.append((at, " ".join(text)))
                at += 1
                text = list(text)
                for _ in range(rng.randrange(1, 2 + size // 40)):
                    text[rng.randrange(len(text))] = "changed" + str(rng.random())
    hub = words(120)
    for k in range(60):
        rows.append((at + k, " ".join(hub[:k] + ["other"] + hub[k + 1:])))
        rows.append((at + 100 + k, " ".join(passage + words(rng.randrange(2, 40)))))
    far, same = " ".join(words(50)), " ".join(words(50))
    rows += [(7000, far), (7000, same), (7001, far), (7002, same), (7000, far), (None, far), (None, "alone and without id"),
             (7003, None), (7004, " "), (7005, "Two words"), (7006, "two  WORDS"), (7005, "Two words")]
    rng.shuffle(rows)
    return rows


def test_near_dedup_equals_all_pairs(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_t", F.lit(7)).withColumn("part", F.lit(7))
    got = stages.near_dedup(spark, df, "")
    assert got.columns == df.columns
    part, want = plain_parts(rows), {}
    for p, (i, t) in zip(part, rows):
        want.setdefault(p, set()).add((i is None, i or 0))
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(kept) == len(want) and set(kept) <= set(rows)
    of = {(i, t): p for p, (i, t) in zip(part, rows)}
    assert sorted((of[k], k[0] or 0) for k in kept) == sorted((p, min(w)[1]) for p, w in want.items())
    assert stages.near_dedup(spark, df.where("false"), "").count() == 0


def test_repeated_doc_ids_stay_in_each_component(spark):
    a, b = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven")
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id bigint, text string")
    assert sorted(r["text"] for r in simhash.one_of_each(df).collect()) == [a, b]


def test_fingerprints_link_sets_before_the_prefix_filter(spark):
    rows = [(i, t) for i, t in planted() if i is not None]
    ids = jaccard.with_ids(spark.createDataFrame(rows, "doc_id bigint, text string"))
    fps = {r["_id"]: r["_fp"] for r in ids.collect()}
    part = {i: i for i in fps}
    for r in jaccard.alike(ids).collect():
        old, new = part[r["a"]], part[r["b"]]
        part = {k: new if p == old else p for k, p in part.items()}
    near = [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (2 ** 64 - 1)).bit_count() <= simhash.THRESHOLD]
    assert near and all(part[a] == part[b] for a, b in near)


def test_near_dedup_stores_no_sets_of_texts_that_have_no_copies(spark):
    import pathlib

    held = lambda: sum(f.stat().st_size for f in pathlib.Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet"))
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(1000))) for i in range(300)]
    df, before = spark.createDataFrame(rows, "doc_id bigint, text string"), held()
    assert stages.near_dedup(spark, df, "").count() == 300
    assert held() - before < 300 * 1000 * 8 / 4


def test_counts_rule_out_no_similar_pair():
    sets = [jaccard.shingles(t or "") for _, t in planted()]
    cells = [jaccard.counts(s) for s in sets]
    kept = ruled_out = 0
    for i in range(len(sets)):
        for j in range(i):
            may = jaccard.may_be_similar(cells[i], cells[j])
            assert may or not jaccard.similar(sets[i], sets[j])
            kept, ruled_out = kept + may, ruled_out + (not may)
    assert ruled_out > kept
