"""Duplicates, ranks and the ledger against row-by-row simulations."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from siftwell.operators import dedup, keyed, ledger

OFFER = "user_id string, job_link string, fingerprint string, ord long, title string"
STORED = "id string, user_id string, job_link string, fingerprint string"


def insert_row_by_row(new, stored):
    """What inserting one row at a time would keep."""
    by_link = {}
    for user, link, fp, ord_, title in new:  # last value wins, first position stays
        first = by_link[(user, link)][3] if (user, link) in by_link else ord_
        by_link[(user, link)] = (user, link, fp, first, title)
    links = {(u, l) for _, u, l, _ in stored}
    prints = {(u, f) for _, u, _, f in stored if f is not None}
    kept = []
    for row in sorted(by_link.values(), key=lambda r: r[3]):
        user, link, fp = row[:3]
        if (user, link) in links or (fp is not None and (user, fp) in prints):
            continue
        links.add((user, link))
        if fp is not None:
            prints.add((user, fp))
        kept.append(row)
    return kept


def test_insert_if_absent_equals_row_by_row(spark):
    rnd = random.Random(3)
    for trial in range(4):
        new = [(rnd.choice("ab"), f"l{rnd.randint(0, 25)}", rnd.choice([None] + [f"f{i}" for i in range(20)]), i, f"t{i}")
               for i in range(120)]
        stored = [(f"s{i}", rnd.choice("ab"), f"l{20 + i}", f"f{15 + i}") for i in range(8)]
        frame, old = spark.createDataFrame(new, OFFER), spark.createDataFrame(stored, STORED)
        got = ledger.insert_if_absent(frame.repartition(3), old).select(
            "user_id", "job_link", "fingerprint", "ord", "title").collect()
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, insert_row_by_row(new, stored))), trial


def test_rows_are_chosen_without_their_texts(spark):
    new = [("u", "l1", "f1", 0, "a"), ("u", None, "f2", 1, "b"), ("u", None, "f3", 2, "c"), ("v", None, None, 3, "d")]
    frame = spark.createDataFrame(new, OFFER)
    found = ledger.insert_if_absent(frame, spark.createDataFrame([], STORED))
    assert sorted((r.user_id, r.fingerprint or "", r.ord, r.title) for r in found.collect()) == [
        ("u", "f1", 0, "a"), ("u", "f3", 1, "c"), ("v", "", 3, "d")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ledger.insert_if_absent(frame, spark.createDataFrame([], STORED))._jdf.queryExecution().executedPlan()
        text = plan.toString()
        assert "SortAggregate" not in text and text.count("HashAggregate") >= 2
        exchanged = [line for line in text.splitlines() if "Project [" in line and "title" in line]
        assert len(exchanged) <= 2  # the wide side of the last join, and the result
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_chained_conflicts(spark):
    new = [("u", "l1", "f1", 0, "a"), ("u", "l2", "f1", 1, "b"), ("u", "l2", "f2", 2, "c"), ("u", "l3", "f2", 3, "d")]
    got = ledger.insert_if_absent(spark.createDataFrame(new, OFFER), spark.createDataFrame([], STORED)).collect()
    assert sorted((r.job_link, r.fingerprint, r.title) for r in got) == [("l1", "f1", "a"), ("l2", "f2", "c")]


def test_second_run_inserts_nothing(spark):
    new = spark.createDataFrame([("u", f"l{i}", f"f{i % 7}" if i % 5 else None, i, "t") for i in range(40)], OFFER)
    first = ledger.insert_if_absent(new, spark.createDataFrame([], STORED))
    stored = first.select("id", "user_id", "job_link", "fingerprint")
    assert ledger.insert_if_absent(new, stored).count() == 0
    assert stored.select("id").distinct().count() == first.count()


def test_id_map_finds_by_link_only(spark):
    new = spark.createDataFrame([("u", "l1", "f9", 0, ""), ("u", "l2", "f8", 1, ""), ("u", "l3", "f1", 2, "")], OFFER)
    stored = spark.createDataFrame([("s1", "u", "l1", "f1"), ("s2", "u", "l7", "f8")], STORED)
    ids = ledger.id_map(new, ledger.insert_if_absent(new, stored), stored)
    got = {r.job_link: r.ledger_id for r in ledger.attach_ids(new, ids).collect()}
    # l1 exists by link; l2 conflicts by content only, so it stays without id; l3 shares l1's stored content
    assert got == {"l1": "s1", "l2": None, "l3": "s1"}


def test_first_wins_does_not_depend_on_partitioning(spark):
    text = "x" * 300
    rows = [("u", i, f"http://x/{i}", "T" if i % 3 else " t ", "C", text + str(i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id string, ord long, link string, title string, company_name string, "
                                     "description_text string")
    want = None
    for n in (1, 2, 7):
        got = sorted(r.ord for r in dedup.unique_in_batch(df.repartition(n, F.rand(5))).collect())
        want = want or got
        assert got == want == [0, 1, 2, 3]


def test_first_per_key_limits_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = keyed.first_per_key(df, ["k"], ["id"])._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan"):]
    assert "Partial" in physical and "WindowGroupLimit" in physical
    assert physical.index("Final") < physical.index("Exchange") < physical.index("Partial")


def test_rank_per_key_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, (i * 7919) % 500) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    got = keyed.rank_per_key(df, ["k"], ["v", "id"], [F.floor(F.col("v") / 50)], "r").collect()
    by_key = {}
    for r in sorted(got, key=lambda r: (r.v, r.id)):
        by_key[r.k] = by_key.get(r.k, 0) + 1
        assert r.r == by_key[r.k]


def test_attach_joins_by_key_without_copying_attributes(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("u"), F.col("id") % 20)).alias("u"), "id")
    users = spark.createDataFrame([(f"u{i}", i) for i in range(15)] + [("a", 99)], "u string, n int")
    plain = sorted(map(tuple, rows.join(F.broadcast(users), "u", "left").collect()), key=repr)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = keyed.attach(rows, users, "u", how="left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Generate" not in plan and "Expand" not in plan and "Broadcast" not in plan
        assert sorted(map(tuple, joined.collect()), key=repr) == plain
        assert keyed.attach(rows, users, "u").count() == sum(r[2] is not None for r in plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_purge_mapping_migrate(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 18)), (255, datetime(2024, 1, 19))],
                               "id long, created_at timestamp")
    kept, removed = ledger.purge(df, F.lit(datetime(2024, 2, 1)))
    assert ([r.id for r in kept.collect()], removed.head()[0]) == ([2, 255], 1)
    changed = ledger.apply_mapping(df.withColumn("k", F.lit("old")), spark.createDataFrame([(2, "new")], "id long, new_value string"),
                                   "id", "k")
    assert {r.id: r.k for r in changed.collect()} == {1: "old", 2: "new", 255: "old"}
    moved = ledger.migrate(df, [("hex_id", "id"), ("drop", "created_at"), ("add", "tags", "array<string>", [])])
    assert sorted(r.id for r in moved.collect())[-1] == "00000000-0000-0000-0000-0000000000ff"
    assert moved.head().tags == []


def test_exports_write_once(spark, tmp_path):
    rows = spark.createDataFrame([("1", "u", "text a"), ("2", "u", None), ("3", "v", "text c"), ("4", "v", "text d")],
                                 "id string, user_id string, text string")
    done = spark.createDataFrame([("4", "k")], "id string, key string")
    status = {r.id: r.export_status for r in ledger.export_status(rows, done).collect()}
    assert status == {"1": "upload", "2": "skipped", "3": "upload", "4": "already_done"}
    new = ledger.export_pending(rows, done, str(tmp_path / "out"))
    assert {r.key for r in new.collect()} == {"job-descriptions/u/1.txt", "job-descriptions/v/3.txt"}
    ledger.export_pending(rows, done.unionByName(new), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_an_export_that_fails_half_way_is_taken_up_again(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("u").alias("user_id"), F.concat(F.lit("text "), "id").alias("text"))
    none, path = spark.createDataFrame([], "id string, key string"), str(tmp_path / "out")
    first = ledger.export_pending(rows.where("id < 100"), none, path, run="monday", waves=4)
    noted, real = [], ledger.folders.replace_text

    def dies(*args):
        noted.append(args)
        if len(noted) == 3:  # two waves are noted, the third is written but not noted
            raise RuntimeError("killed")
        return real(*args)

    with monkeypatch.context() as m:
        m.setattr(ledger.folders, "replace_text", dies)
        try:
            ledger.export_pending(rows, first, path, run="tuesday", waves=4)
            raise AssertionError
        except RuntimeError:
            pass
    seen = ledger.read_texts(spark, path).count()
    assert 100 < seen < 400
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "run=tuesday").rglob("*.parquet") if "wave=0" in str(p) or "wave=1" in str(p)}
    new = ledger.export_pending(rows, first, path, run="tuesday", waves=4)
    assert new.count() == 300 and all(p.stat().st_mtime_ns == t for p, t in kept.items())
    texts = ledger.read_texts(spark, path)
    assert texts.count() == texts.select("id").distinct().count() == 400
    assert ledger.export_pending(rows, first.unionByName(new), path).count() == 0
    assert texts.where("text <> concat('text ', id)").count() == 0


def test_store_descriptions(spark, tmp_path):
    rows = spark.createDataFrame([("u", "i1", "long"), ("u", None, "x"), ("u", "i2", "")],
                                 "user_id string, ledger_id string, description_text string")
    mapping = ledger.store_descriptions(rows, str(tmp_path / "d")).collect()
    assert [(r.id, r.new_value) for r in mapping] == [("i1", "job-descriptions/u/i1.txt")]
    assert spark.read.parquet(str(tmp_path / "d")).select("text").head()[0] == "long"


def test_site_key_and_cap(spark):
    df = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "", 3), ("q", None, 4), ("p", "a", 5), ("q", "b", 6)],
                               "q string, key string, pos int")
    assert sorted(r.pos for r in dedup.unique_by_key(df, ["q"], "key", ["pos"]).collect()) == [1, 5, 6]
    assert sorted(r.pos for r in dedup.cap_per_query(df, ["q"], ["pos"], 2).collect()) == [1, 2, 5]
