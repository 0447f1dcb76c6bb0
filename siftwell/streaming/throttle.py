"""At most one release per user and slot, on a stream.

Two forms with the same results. ``start_throttle`` counts a micro-batch's items in groups that many tasks
share and keeps one number a user in a table beside the releases: for users with any number of items.
``throttle`` is a plain stream to stream step with that number in the state store; a user's arrivals of a
trigger meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from siftwell.constants import QUEUE_EXPIRY_DAYS, SLOT_MINUTES
from siftwell.operators import queue as slots_of
from siftwell.session import materialize
from siftwell.sources import folders

FRAME = 10_000  # rows of an output frame
OUTPUT = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()),
    T.StructField("enqueued_at", T.TimestampType()), T.StructField("release_at", T.TimestampType()),
    T.StructField("expired", T.BooleanType()),
])


class SlotThrottle(StatefulProcessor):
    """Gives every arriving item its release slot at once.

    The queue of a user is first in, first out with one release per slot, so the release time of an
    item depends only on its arrival and the user's next free slot. That one number is the whole
    state; items are not kept. An item that would wait longer than the queue keeps messages is
    marked expired and uses no slot. Rows of a trigger may come in several frames in any order: their
    times and ids (two numbers an item) are gathered and put in order first.
    """

    def __init__(self, slot_ms: int, keep_ms: int):
        self.slot_ms, self.keep_ms = slot_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next_free = handle.getValueState("next_free", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        free = self.next_free.get()[0] if self.next_free.exists() else 0
        queue = pd.concat([f[["enqueued_at", "item_id"]] for f in rows]).sort_values(["enqueued_at", "item_id"])
        arrivals = (queue["enqueued_at"].astype("datetime64[us]").astype("int64") // 1000).to_numpy()
        slots, free = assign_slots(arrivals, free, self.slot_ms, self.keep_ms)
        release = pd.Series(slots.astype("datetime64[ms]")).where(slots >= 0)
        for at in range(0, len(queue), FRAME):
            part = queue.iloc[at:at + FRAME]
            yield pd.DataFrame({
                "user_id": [key[0]] * len(part), "item_id": part["item_id"].tolist(),
                "enqueued_at": part["enqueued_at"].tolist(),
                "release_at": release.iloc[at:at + FRAME].astype("datetime64[ns]").tolist(),
                "expired": (slots[at:at + FRAME] < 0).tolist(),
            })
        self.next_free.update((int(free),))

    def close(self) -> None:
        pass


def assign_slots(arrivals: np.ndarray, free: int, slot_ms: int, keep_ms: int) -> tuple[np.ndarray, int]:
    """Release time of each of the sorted ``arrivals`` (-1: expired) and the next free slot after them.

    Without expiry the n-th release is n + the largest of (own slot - n) so far. That holds up to the first
    item that would wait too long; from there items expire until one is late enough for the next free
    slot, and the formula starts anew. So work is one pass for each stretch, not one for each item.
    """
    out = np.full(len(arrivals), -1, np.int64)
    own, start = -(-arrivals // slot_ms), 0
    free = -(-free // slot_ms)
    while start < len(arrivals):
        size = 64
        while True:  # stretches may be short, so look ahead in growing steps
            n = np.arange(min(size, len(arrivals) - start))
            slots = n + np.maximum(np.maximum.accumulate(own[start:start + len(n)] - n), free)
            late = slots * slot_ms - arrivals[start:start + len(n)] > keep_ms
            if late.any() or start + len(n) == len(arrivals):
                break
            size *= 8
        fit = int(np.argmax(late)) if late.any() else len(n)
        out[start:start + fit] = slots[:fit] * slot_ms
        if fit:
            free = int(slots[fit - 1]) + 1
        start += fit
        if start < len(arrivals):
            start = max(start, int(np.searchsorted(arrivals, free * slot_ms - keep_ms)))
    return out, free * slot_ms


def throttle(queue: DataFrame, minutes: int = SLOT_MINUTES, keep_days: int = QUEUE_EXPIRY_DAYS) -> DataFrame:
    """Stream of (user_id, item_id, enqueued_at) to release times. The session must use the RocksDB state
    store (``session.SETTINGS`` does)."""
    return queue.groupBy("user_id").transformWithStateInPandas(
        SlotThrottle(minutes * 60_000, keep_days * 86_400_000), OUTPUT, "append", "None")


def release_batch(batch: DataFrame, batch_id: int, out: str, minutes: int, keep_days: float) -> None:
    """One micro-batch of ``start_throttle``: its releases, and where its users and all others stand after it.

    It reads the standing of the micro-batch before and replaces its own, so a repeated one changes nothing."""
    spark = batch.sparkSession
    user = batch.schema["user_id"].dataType
    standing = f"{out}/_free/{batch_id - 1}"
    free = spark.read.schema(T.StructType([T.StructField("user_id", user), T.StructField("free", T.LongType())])).parquet(standing) \
        if folders.exists(spark, standing) else None
    items = batch.select("user_id", "item_id", "enqueued_at").where(F.col("user_id").isNotNull() & F.col("enqueued_at").isNotNull())
    grouped = slots_of.slot_groups(items, minutes, keep_days)
    plan = materialize(slots_of.plan_groups(grouped, free), "plan")
    slots_of.apply_plan(grouped, plan, minutes, keep_days).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    now = plan.groupBy("user_id").agg(F.max("free").alias("free")).where(F.col("free").isNotNull())
    after = now if free is None else free.unionByName(now).groupBy("user_id").agg(F.max("free").alias("free"))
    after.write.mode("overwrite").parquet(f"{out}/_free/{batch_id}")
    folders.delete(spark, f"{out}/_free/{batch_id - 2}")


def start_throttle(stream: DataFrame, out: str, checkpoint: str, minutes: int = SLOT_MINUTES,
                   keep_days: float = QUEUE_EXPIRY_DAYS, once: bool = True):
    """Start the query that writes release times of a stream of (user_id, item_id, enqueued_at) to ``out``;
    ``released`` reads them. Items are served in order of arrival within a micro-batch and micro-batch after
    micro-batch; rows without a user or an arrival are dropped."""
    def write(batch: DataFrame, batch_id: int) -> None:
        release_batch(batch, batch_id, out, minutes, keep_days)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def released(spark: SparkSession, out: str) -> DataFrame:
    """What ``start_throttle`` wrote: user_id, item_id, enqueued_at, release_at, expired."""
    return spark.read.parquet(f"{out}/batch_id=*")
