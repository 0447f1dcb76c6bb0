"""What tasks of the pipeline hold at a time."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftwell.llm import quality
from siftwell.session import BOUNDS, bound_batches


def restored(spark, run):
    before = {key: spark.conf.get(key, None) for key in BOUNDS}
    try:
        return run()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_batches_to_workers_stay_near_a_megabyte(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    def run():
        docs = bound_batches(spark).range(200, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
        return docs.mapInArrow(sizes, "n bigint, size bigint").collect()

    found = restored(spark, run)
    assert sum(r["n"] for r in found) == 200
    assert max(r["size"] for r in found) < 1_300_000


def test_small_partitions_are_joined_without_sorting(spark):
    def run():
        bound_batches(spark)
        key = "spark.sql.autoBroadcastJoinThreshold"
        old, advisory = spark.conf.get(key), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
        spark.conf.set(key, "-1")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
        try:
            joined = spark.range(1000).join(spark.range(500, 1500), "id")
            assert sorted(r["id"] for r in joined.collect()) == list(range(500, 1000))
            return joined._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set(key, old)
            if advisory is None:
                spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
            else:
                spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)

    final = restored(spark, run).split("Initial Plan")[0]
    assert "ShuffledHashJoin" in final and "SortMergeJoin" not in final


def brute(rows):
    out = Counter()
    for text, lang in rows:
        padded = "\n" * (quality.ORDER - 1) + (text or "")
        out.update((lang, padded[i:i + quality.ORDER]) for i in range(len(text or "")))
    return out


def test_ngrams_of_many_small_batches_are_merged_together(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("".join(rng.choice(list("abcdé \U0001f600"), 60)), ["en", "fr", None][i % 3]) for i in range(300)] + [(None, "en"), ("", None)]
    batches = [pa.RecordBatch.from_pylist([{"text": t, "lang": lang}]) for t, lang in rows]
    merges = []
    merged = quality.merged
    monkeypatch.setattr(quality, "merged", lambda parts: merges.append(len(parts)) or merged(parts))

    def run():
        found, times = Counter(), Counter()
        for lang, grams, n in quality.counted(iter(batches)):
            for g, k in zip(grams, n):
                gram = g.tobytes().decode("utf-32-le")
                found[lang, gram] += int(k)
                times[lang, gram] += 1
        return found, times

    found, times = run()
    assert found == brute(rows) and set(times.values()) == {1}
    assert len(merges) == 3  # one a language; each batch was merged with all before it
    monkeypatch.setattr(quality, "WAITING", 500)
    monkeypatch.setattr(quality, "HELD", 2000)
    found, times = run()
    assert found == brute(rows) and max(times.values()) > 1
