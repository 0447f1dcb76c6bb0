"""Streams over several triggers against plain simulations."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.streaming import clicks as C, seen, throttle as T

START = datetime(2024, 1, 1)


@pytest.fixture
def replay(spark, tmp_path):
    """Write frames as files one after the other and read them back as a stream, one per trigger."""

    def run(frames):
        for i, df in enumerate(frames):
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def finish(stream, mode="append"):
        out = str(tmp_path / "out")
        writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).outputMode(mode).trigger(availableNow=True)
        if mode == "append":
            writer.format("parquet").option("path", out).start().awaitTermination()
        else:
            writer.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out)).start().awaitTermination()
        return spark.read.parquet(out)

    return run, finish


@pytest.fixture(params=["sights", "state store"])
def sights(request, spark, replay, tmp_path):
    """First sights of a replayed stream, by either form."""

    def finish(stream):
        if request.param == "state store":
            return replay[1](seen.first_seen(stream))
        seen.start_first_seen(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return seen.seen_rows(spark, str(tmp_path / "out"), stream.schema)

    return finish


def test_first_seen_across_triggers(spark, replay, sights):
    run, finish = replay[0], sights
    rows = lambda day, *keys: spark.createDataFrame(
        [("u", k, START + timedelta(days=day)) for k in keys], "user_id string, fingerprint string, scraped_at timestamp")
    stream = run([rows(0, "a", "b", "a"), rows(1, "b", "c"), rows(13, "a"), rows(14, "a", "a"), rows(20, "b", "a"), rows(40, "b")])
    got = finish(stream)
    assert sorted((r.fingerprint, (r.scraped_at - START).days) for r in got.collect()) == [
        ("a", 0), ("a", 14), ("b", 0), ("b", 20), ("b", 40), ("c", 1)]


def test_slots_of_many_shuffled_items_in_small_frames(spark, replay):
    run, finish = replay
    rows = spark.range(25_000).select(
        F.lit(1).cast("long").alias("user_id"), F.col("id").alias("item_id"),
        (F.lit(START).cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("enqueued_at")).orderBy(F.xxhash64("item_id"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = finish(T.throttle(run([rows])))
        assert got.count() == 25_000 and got.where("expired or release_at <> enqueued_at").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_slots_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    for most, n, keep in ((50, 300, 40), (5000, 300, 40), (100, 2000, 10 ** 9), (10, 0, 5), (1, 200, 30)):
        arrivals, free = np.sort(rng.integers(0, most, n)), 0
        got, last = T.assign_slots(arrivals, 0, 7, keep)
        for ms, slot in zip(arrivals, got):
            due = max(free, -(-ms // 7) * 7)
            assert slot == (due if due - ms <= keep else -1)
            free = due + 7 if due - ms <= keep else free
        assert last == free


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from siftwell.session import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_drop_late(spark):
    df = spark.createDataFrame([("2024-01-30",), ("2023-01-01",), (None,)], "posted_at string")
    assert seen.drop_late(df, F.lit(datetime(2024, 2, 1))).count() == 2


def test_running_clicks(spark, replay):
    run, finish = replay
    rows = lambda *r: spark.createDataFrame(list(r), "jobId string, userId string, source string, type string")
    ledger = spark.createDataFrame([("j", "owner")], "id string, user_id string")
    stream = run([rows((None, "u", "telegram", "apply"), ("j", None, "Dashboard", "Resume")),
                  rows((None, "u", "telegram", "apply"), ("zz", None, "telegram", "apply"), (None, "u", "tv", "apply"))])
    got = {(r.user_id, r.key): r.clicks for r in finish(C.running_clicks(stream, ledger), "complete").collect()}
    assert got == {("u", "telegram_apply"): 2, ("owner", "dashboard_resume"): 1}


def test_daily_activity_uses_local_days(spark, replay):
    run, finish = replay
    rows = lambda *r: spark.createDataFrame(list(r), "run_at timestamp, actual_cost_usd double")
    stream = run([rows((datetime(2024, 1, 1, 18, 29), 1.0), (datetime(2024, 1, 1, 18, 30), 2.0)), rows((datetime(2024, 1, 2, 18, 0), 4.0))])
    got = {r.day: (r.runs_count, r.total_cost_usd) for r in finish(C.daily_activity(stream), "complete").collect()}
    assert got == {"2024-01-01": (1, 1.0), "2024-01-02": (2, 6.0)}


def test_throttle_over_triggers_with_backlog_and_expiry(spark, replay):
    run, finish = replay
    minute = lambda m: START + timedelta(minutes=m)
    waves = [[(1, i, minute(i % 3)) for i in range(230)], [(2, 1000, minute(5)), (2, 1001, minute(30))], [(1, 2000, minute(40)), (2, 1002, minute(200))]]
    frames = [spark.createDataFrame(w, "user_id long, item_id long, enqueued_at timestamp") for w in waves]
    got = {r.item_id: r for r in finish(T.throttle(run(frames))).collect()}
    free, slot, keep = {}, timedelta(minutes=30), timedelta(days=4)
    assert len(got) == sum(map(len, waves))
    for wave in waves:
        for uid, item, at in sorted(wave, key=lambda r: (r[2], r[1])):
            due = START + slot * -(-(at - START) // slot)
            due = max(due, free.get(uid, due))
            late = due - at > keep
            assert got[item].expired == late, item
            assert got[item].release_at == (None if late else due), item
            if not late:
                free[uid] = due + slot
    assert sum(r.expired for r in got.values()) > 0


def test_first_sights_that_come_late_are_kept(spark, replay, sights):
    run, finish = replay[0], sights
    rows = lambda *r: spark.createDataFrame(
        [("u", k, START + timedelta(days=d)) for k, d in r], "user_id string, fingerprint string, scraped_at timestamp")
    stream = run([rows(("a", 20)), rows(("b", 21)), rows(("c", 22)), rows(("late", 9), ("later", 19), ("a", 21)),
                  rows(("late", 12), ("lost", 1)), rows(("late", 23), ("later", 22))])
    got = finish(stream)
    assert sorted((r.fingerprint, (r.scraped_at - START).days) for r in got.collect()) == [
        ("a", 20), ("b", 21), ("c", 22), ("late", 9), ("late", 23), ("later", 19)]


def plain_sights(waves, days, lateness):
    """First sights of (key, day) rows in waves, one after the other."""
    since, newest, out = {}, None, []
    for wave in waves:
        for key, day in sorted(wave, key=lambda r: r[1]):
            if newest is not None and day < newest - lateness:
                continue
            if key not in since or day >= since[key] + days:
                since[key] = day
                out.append((key, day))
        newest = max([d for _, d in wave] + ([newest] if newest is not None else []))
    return sorted(out, key=repr)


def test_shuffled_replay_with_null_keys_and_long_batches(spark, replay, tmp_path):
    random.seed(5)
    waves = [[(random.choice("abcdefgh") if random.random() < 0.9 else None, max(0, 12 * w + random.randrange(-15, 40))) for _ in range(60)]
             for w in range(6)]
    frames = [spark.createDataFrame([(k, START + timedelta(days=d)) for k, d in wave], "k string, at timestamp").repartition(3)
              for wave in waves]
    stream = replay[0](frames)
    seen.start_first_seen(stream, str(tmp_path / "out"), str(tmp_path / "state"), time="at", keys=("k",),
                          days=7, lateness_days=20).awaitTermination()
    got = [(r.k, (r["at"] - START).days) for r in seen.seen_rows(spark, str(tmp_path / "out"), stream.schema).collect()]
    assert sorted(got, key=repr) == plain_sights(waves, 7, 20)
    newest = max(d for wave in waves[:-1] for _, d in wave)  # at the last micro-batch
    old = seen.forgotten(spark, str(tmp_path / "out"))
    assert old == [f"batch_id={i}" for i, wave in enumerate(waves) if max(d for _, d in wave) < newest - 27]


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(
        [(k, START + timedelta(days=d)) for k, d in r], "k string, at timestamp")
    out = str(tmp_path / "out")
    sights = seen.Sights(out, rows(("a", 0)).schema, "at", ("k",))
    for batch_id, batch in [(0, rows(("a", 0), ("b", 1))), (1, rows(("a", 3), ("c", 4))), (1, rows(("a", 3), ("c", 4))), (2, rows(("c", 5), ("b", 15)))]:
        seen.first_sights(batch, sights, batch_id, 14, timedelta(days=14))
    got = seen.seen_rows(spark, out, rows(("a", 0)).schema).collect()
    assert sorted((r.k, (r["at"] - START).days) for r in got) == [("a", 0), ("b", 1), ("b", 15), ("c", 4)]


def test_many_known_keys_are_asked_by_a_join_that_broadcasts_none(spark):
    rows = spark.range(50).select(F.concat(F.lit("k"), F.col("id") % 20).alias("k"), F.lit(START).cast("timestamp").alias("at"))
    known = spark.range(10, 5000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(START - timedelta(days=3)).cast("timestamp").alias("_since"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(r.k for r in seen.anti_known(rows, known, ("k",), "at", 14).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = seen.anti_known(rows, known, ("k",), "at", 14)
        plan = asked._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan and "LeftAnti" in plan
        assert sorted(r.k for r in asked.collect()) == want == sorted(f"k{i % 20}" for i in range(50) if i % 20 < 10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plain_releases(waves, slot, keep):
    """item -> release minute, or None, of (user, item, minute) rows, wave after wave."""
    free, out = {}, {}
    for wave in waves:
        for user, item, at in sorted(wave, key=lambda r: (r[2], r[1])):
            due = max(-(-at // slot), free.get(user, 0))
            late = due * slot - at > keep
            out[item] = None if late else due * slot
            if not late:
                free[user] = due + 1
    return out


@pytest.mark.parametrize("keep_days", [1.0, 0.01, 0.013])
def test_throttle_by_groups_equals_a_plain_loop(spark, replay, tmp_path, keep_days):
    random.seed(9)
    item = iter(range(10 ** 6))
    waves = [[(random.choice([1, 1, 1, 2, 3]), next(item), w * 900 + random.choice([0, 0, 30, random.randrange(900)])) for _ in range(150)]
             for w in range(3)]
    epoch = datetime(1970, 1, 1)
    frames = [spark.createDataFrame([(u, i, epoch + timedelta(minutes=m)) for u, i, m in wave], "user_id long, item_id long, enqueued_at timestamp")
              .unionAll(spark.sql("SELECT null, 0L, timestamp '2024-01-01'")) for wave in waves]
    T.start_throttle(replay[0](frames), str(tmp_path / "out"), str(tmp_path / "state"), keep_days=keep_days).awaitTermination()
    got = {r.item_id: None if r.expired else int((r.release_at - epoch).total_seconds()) // 60 for r in T.released(spark, str(tmp_path / "out")).collect()}
    assert got == plain_releases(waves, 30, keep_days * 1440)
    # the last micro-batch again: the same
    T.release_batch(frames[2], 2, str(tmp_path / "out"), 30, keep_days)
    assert {r.item_id: None if r.expired else int((r.release_at - epoch).total_seconds()) // 60
            for r in T.released(spark, str(tmp_path / "out")).collect()} == got


def test_one_users_moment_is_ranked_by_many_tasks(spark):
    from siftwell.operators import queue

    rows = spark.range(4000).select((F.col("id") % 1).alias("user_id"), (F.col("id") * 7919 % 4000).alias("item_id"),
                                    F.lit(START).cast("timestamp").alias("enqueued_at"))
    late = spark.range(4000, 4100).select(F.lit(0).cast("bigint"), F.col("id"), F.lit(START + timedelta(hours=1)).cast("timestamp"))
    got = queue.release_slots(rows.unionAll(late), F.lit(START).cast("timestamp"), moment_rows=1000)
    assert [r.slot_no for r in got.orderBy("item_id").collect()] == list(range(1, 4101))
    split, part = queue.split_buckets(rows, ["user_id"], F.date_trunc("minute", "enqueued_at"), ("enqueued_at", "item_id"), 1000)
    sizes = [r["count"] for r in split.groupBy(part.alias("part")).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 200
    # with expiry only as many of a moment are ranked as slots fit into the time that items are kept
    grouped = queue.slot_groups(rows, 30, 1)
    plan = queue.apply_plan(grouped, queue.plan_groups(grouped), 30, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert queue.releases(rows, START.replace(tzinfo=timezone.utc), keep_days=1).where("not expired").count() == 49


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    from siftwell.workload.streams import run_to_files, stream_table

    spark.range(0, 50, numPartitions=5).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "made"))
    (part,) = (tmp_path / "made").glob("*.parquet")
    (tmp_path / "one.parquet").write_bytes(part.read_bytes())
    assert run_to_files(stream_table(spark, str(tmp_path), "many"), "many").count() == 50
    assert run_to_files(stream_table(spark, str(tmp_path), "one"), "one").count() == 7
