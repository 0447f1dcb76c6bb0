"""Product codes against plain arithmetic, and the tree against looking at all entries."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import gnat, queries

SF = "/root/testdata/sf0.001"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error) and the codebooks of (vec_id, vector) rows with different ids."""
    kept = {i: [int(np.floor(4096 * float(x))) for x in v] for i, v in rows
            if v and all(x is not None and np.isfinite(x) for x in v)}
    width = len(next(iter(kept.values()))) // parts
    cut = {i: [v[p * width:(p + 1) * width] for p in range(parts)] for i, v in kept.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in cut.values():
                members.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for k, vs in members.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    out = {}
    for i, v in cut.items():
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, books


def digest(books):
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


@pytest.mark.parametrize("width,spread", [(1, 3), (2, 2), (8, 4096), (3, 40)])
def test_tree_finds_the_first_nearest_entry(width, spread):
    random.seed(width)
    rng = np.random.default_rng(width)
    for n in (1, 2, 5, 16, 60, 200):
        entries = rng.integers(-spread, spread + 1, (n, width))
        asked = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (300, width)), entries])
        far = ((asked[:, None] - entries[None]) ** 2).sum(2)
        which, best, _ = gnat.Gnat(entries).nearest(asked)
        assert (which == far.argmin(1)).all() and (best == far.min(1)).all()


def test_tree_leaves_subtrees_out_and_keeps_ties():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (8, 8))
    entries = (centres[:, None] + rng.integers(-20, 20, (8, 8, 8))).reshape(-1, 8)
    asked = entries[rng.integers(0, 64, 5000)] + rng.integers(-15, 15, (5000, 8))
    which, best, seen = gnat.Gnat(entries).nearest(asked)
    assert (best == ((asked[:, None] - entries[None]) ** 2).sum(2).min(1)).all()
    assert seen < 0.6 * 5000 * 64
    # all entries as far as each other from the middle: the lowest index is found
    ring = np.array([(3, 4), (4, 3), (-3, 4), (0, 5), (5, 0), (-4, -3), (0, -5), (4, -3), (-5, 0), (3, -4)])
    for turn in range(len(ring)):
        assert gnat.Gnat(np.roll(ring, turn, 0)).nearest(np.zeros((1, 2), np.int64))[0].tolist() == [0]
    assert gnat.Gnat(np.array([[5, 5], [1, 1], [5, 5], [1, 1]])).nearest(np.array([[1, 1], [6, 6], [3, 3]]))[0].tolist() == [1, 0, 0]


def test_bounds_hold_for_all_sizes():
    squared = np.array([0, 1, 2, 3, 15, 16, 17, 2 ** 52 + 1, 2 ** 53 + 1, 10 ** 17 + 3, 2 ** 62 - 1])
    low, high = gnat.below(squared), gnat.above(squared)
    for s, a, b in zip(squared.tolist(), low.tolist(), high.tolist()):
        from fractions import Fraction
        assert Fraction(a) ** 2 <= s <= Fraction(b) ** 2


def test_query_equals_plain_version_and_sql(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want, books = plain([(r["vec_id"], r["embedding"]) for r in rows])
    label = {r["vec_id"]: r["label"] for r in rows}
    total = {}
    for i, (_, error) in want.items():
        total[label[i]] = total.get(label[i], 0) + error
    want = sorted((i, code, error, total[label[i]], digest(books)) for i, (code, error) in want.items())
    columns = "vec_id", "code", "error", "label_error", "codebooks_sha256"
    assert sorted(tuple(r) for r in queries.QUERIES["op12_product_codes"](spark, SF).select(*columns).collect()) == want
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        assert sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL['op12_product_codes']})").fetchall()) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).round(2).tolist(), i % 3 or None) for i in range(40)]
    rows += [(50, None, 1), (51, [], 1), (52, [float("nan")] + [0.0] * 15, 1), (53, [float("inf")] + [0.0] * 15, 1),
             (54, [None] + [0.0] * 15, 1), (55, [1.0] * 8, 1), (56, [0.0] * 16, None), (None, [0.5] * 16, 2)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int") \
        .withColumn("code", F.lit("x")).withColumn("_v", F.lit(1))
    good = [(i if i is not None else 10 ** 6, np.array(v, np.float32).tolist()) for i, v, _ in rows
            if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)]
    want, books = plain(good)
    coded, got = gnat.compress(vectors, "vec_id", ["vec_id", "label"])
    assert got.tolist() == books
    assert sorted((r["vec_id"] if r["vec_id"] is not None else 10 ** 6, r["code"].hex(), r["error"]) for r in coded.collect()) \
        == sorted((i, *x) for i, x in want.items())
    # a repeated row weighs twice and starts one entry
    few = spark.createDataFrame([(1, [float(x)] * 8) for x in (0, 0)] + [(2, [3.0] * 8)], "vec_id bigint, embedding array<double>")
    coded, got = gnat.compress(few, "vec_id", ["vec_id"])
    assert got[:, :, 0].tolist() == [[0, 3 * 4096]] * 8 and coded.count() == 3
    assert gnat.compress(few.where("false"), "vec_id", ["vec_id"])[0].count() == 0
    assert gnat.compress(few.withColumn("vec_id", F.lit(None).cast("bigint")), "vec_id", ["vec_id"])[0].count() == 0
    with pytest.raises(ValueError):
        gnat.compress(few.withColumn("embedding", F.array(*[F.lit(1.0)] * 9)), "vec_id", ["vec_id"])
    with pytest.raises(ValueError):
        gnat.scaled(np.array([1e30]))
