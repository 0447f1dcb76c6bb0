"""Seen-before state on a stream.

Three forms. ``start_first_seen`` asks the table of earlier first sights once a micro-batch, with joins and
windows only: the form for many keys. ``first_seen`` keeps them in Spark's state store, with a
Python call for each key and trigger: a plain stream to stream step, for few keys. Both remember every
posting for the retention time, counted from a key's first sight. The ledger form (``ingest``) is the
service's own rule: only evaluated postings are remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftwell.constants import FRESHNESS_DAYS, RETENTION_DAYS
from siftwell.operators.keyed import first_per_key
from siftwell.operators.rules import fresh
from siftwell.sources import folders


class FirstSeen(StatefulProcessor):
    """Lets a key's first row through and drops its repeats until ``keep_ms`` after that row; the row after
    is a first one again. State is one time per key, dropped when the watermark passes its end."""

    def __init__(self, time: str, keep_ms: int):
        self.time, self.keep_ms = time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since = self.since.get()[0] if self.since.exists() else None
        best: list[pd.DataFrame] = []
        # only rows that may still be first are kept between frames: one for each life of the key
        for frame in rows:
            ms = frame[self.time].astype("datetime64[us]").astype("int64") // 1000
            frame = frame.assign(_life=0 if since is None else (ms >= since + self.keep_ms).astype(int), _ms=ms)
            if since is not None:
                frame = frame[frame["_life"] == 1]
            best.append(frame.sort_values("_ms", kind="stable").drop_duplicates("_ms"))
        if not best:
            return
        found = pd.concat(best).sort_values("_ms", kind="stable")
        times, firsts, at = found["_ms"].to_numpy(), [], 0
        while at < len(times):
            firsts.append(at)
            since = int(times[at])
            at = int(np.searchsorted(times, since + self.keep_ms))
        if firsts:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.since.update((since,))
            self.handle.registerTimer(since + self.keep_ms)
            yield found.iloc[firsts].drop(columns=["_life", "_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.since.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, time: str = "scraped_at", keys=("user_id", "fingerprint"),
               days: int = RETENTION_DAYS, lateness: str | None = None) -> DataFrame:
    """The first row of each key, then the first one ``days`` or more after it, and so on.

    Rows later than ``lateness`` (``days`` by default) behind the newest are dropped, as their key's time may
    be forgotten; a key is kept for ``days`` and the lateness. A late row of a known key is a repeat.
    Columns stay; ``stream`` must not have one called _life or _ms. The session must use the RocksDB state
    store (``session.SETTINGS`` does).
    """
    lateness = f"{days} days" if lateness is None else lateness
    return stream.withWatermark(time, lateness).groupBy(*keys).transformWithStateInPandas(
        FirstSeen(time, days * 86_400_000), stream.schema, "append", "EventTime")


class Sights:
    """First sights as ``<path>/batch_id=<micro-batch>``, which are also the memory of known keys.

    Beside them, ``<path>/_marks/<micro-batch>`` says how new the rows so far were and which micro-batches
    hold sights that can still matter, so others are neither listed nor read. A micro-batch reads the mark
    and the sights of earlier ones and replaces its own: one that is repeated after a failure gives the same
    tables.
    """

    def __init__(self, path: str, schema: T.StructType, time: str, keys: tuple[str, ...]):
        self.path, self.schema, self.time, self.keys = path, schema, time, keys

    def mark(self, spark: SparkSession, batch_id: int) -> tuple[datetime | None, dict[int, datetime]]:
        """The newest time up to a micro-batch, and that of each micro-batch still remembered."""
        text = folders.read_text(spark, f"{self.path}/_marks/{batch_id}")
        found = json.loads(text) if text else {"newest": None, "held": {}}
        return found["newest"] and datetime.fromisoformat(found["newest"]), \
            {int(i): datetime.fromisoformat(t) for i, t in found["held"].items()}

    def set_mark(self, spark: SparkSession, batch_id: int, newest: datetime | None, held: dict[int, datetime]) -> None:
        found = {"newest": newest and newest.isoformat(), "held": {str(i): t.isoformat() for i, t in held.items()}}
        folders.replace_text(spark, f"{self.path}/_marks/{batch_id}", json.dumps(found))
        # the one before is needed if this micro-batch is repeated
        folders.delete(spark, f"{self.path}/_marks/{batch_id - 2}")

    def of(self, spark: SparkSession, batches: list[int]) -> DataFrame:
        """Keys and _since of some micro-batches; no other columns are read."""
        rows = T.StructType([self.schema[c] for c in (*self.keys, self.time)])
        found = spark.read.schema(rows).parquet(*(f"{self.path}/batch_id={i}/round=*" for i in batches)) if batches \
            else spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows))
        return found.select(*self.keys, F.col(self.time).alias("_since"))


def anti_known(rows: DataFrame, known: DataFrame, keys: tuple[str, ...], time: str, days: int) -> DataFrame:
    """``rows`` without repeats: those at or before a known first sight of their key, or less than ``days`` after.

    Spark broadcasts the known keys where their files are under its threshold. Above it, only keys that the
    rows hold go on to the join (Spark adds a Bloom filter to the scan of a large side there)."""
    spark = rows.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()

    def same(other: str, condition: Column) -> Column:
        for k in keys:
            condition = F.col(k).eqNullSafe(F.col(f"{other}{k}")) & condition
        return condition

    if int(str(known._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > limit:
        asked = rows.select(*(F.col(k).alias(f"_a_{k}") for k in keys)).distinct()
        known = known.join(asked, same("_a_", F.lit(True)), "left_semi")
    known = known.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_since")
    repeat = F.col(time) < F.col("_since") + F.make_interval(days=F.lit(days))
    return rows.join(known, same("_k_", repeat), "left_anti")


def first_sights(batch: DataFrame, sights: Sights, batch_id: int, days: int, lateness: timedelta) -> None:
    """One micro-batch of ``start_first_seen``."""
    spark, keys, time, life = batch.sparkSession, sights.keys, sights.time, timedelta(days=days)
    newest, held = sights.mark(spark, batch_id - 1)
    rows = batch.where(F.col(time).isNotNull())
    if newest is not None:
        rows = rows.where(F.col(time) >= F.lit(newest - lateness))
        held = {i: t for i, t in held.items() if t >= newest - lateness - life}
    target, times = f"{sights.path}/batch_id={batch_id}", Observation()
    known = sights.of(spark, list(held))
    todo = anti_known(rows.observe(times, F.min(time).alias("low"), F.max(time).alias("high")), known, keys, time, days)
    folders.delete(spark, target)
    first_per_key(todo, list(keys), [time]).write.parquet(f"{target}/round=0")
    low, high = times.get["low"], times.get["high"]
    for n in range(1, 1 + (0 if low is None else (high - low) // life)):
        # the batch spans several lives of a key: rows past the sights just found are asked again
        known = known.unionAll(spark.read.schema(batch.schema).parquet(f"{target}/round={n - 1}").select(*keys, F.col(time).alias("_since")))
        first_per_key(anti_known(rows, known, keys, time, days), list(keys), [time]).write.parquet(f"{target}/round={n}")
    if high is not None:
        newest, held[batch_id] = max(high, newest or high), high
    sights.set_mark(spark, batch_id, newest, held)


def start_first_seen(stream: DataFrame, out: str, checkpoint: str, time: str = "scraped_at",
                     keys: tuple[str, ...] = ("user_id", "fingerprint"), days: int = RETENTION_DAYS,
                     lateness_days: int | None = None, once: bool = True):
    """Start the query that writes to ``out`` the first row of each key, then the first one ``days`` or more
    after it, and so on; ``seen_rows`` reads them.

    Rows later than ``lateness_days`` (``days`` by default) behind the newest of earlier micro-batches are
    dropped. A late row of a known key is a repeat; null keys are keys. Of rows of one key and time, one is
    taken. Rows without a time are dropped. A micro-batch asks only earlier ones that hold sights of the
    retention and the lateness; ``forgotten`` lists the rest, which nothing reads again.
    """
    sights = Sights(out, stream.schema, time, tuple(keys))
    lateness = timedelta(days=days if lateness_days is None else lateness_days)

    def write(batch: DataFrame, batch_id: int) -> None:
        first_sights(batch, sights, batch_id, days, lateness)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def seen_rows(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """What ``start_first_seen`` wrote, with the columns of its stream."""
    return spark.read.schema(schema).parquet(f"{out}/batch_id=*/round=*")


def forgotten(spark: SparkSession, out: str) -> list[str]:
    """Folders of micro-batches whose sights no later one asks for; they may be moved or dropped whole."""
    marks = [int(name) for name in folders.children(spark, f"{out}/_marks") if name.isdigit()]
    if not marks:
        return []
    held = json.loads(folders.read_text(spark, f"{out}/_marks/{max(marks)}"))["held"]
    numbered = [(name, name.partition("=")[2]) for name in folders.children(spark, out) if name.startswith("batch_id=")]
    return [name for name, i in numbered if i not in held and int(i) < max(marks) - 1]


def drop_late(stream: DataFrame, now: Column | None = None, days: int = FRESHNESS_DAYS) -> DataFrame:
    """Postings older than ``days`` at processing time leave; undated ones stay. A plain filter on
    the posting's own date, independent of the watermark."""
    return fresh(stream, F.current_timestamp() if now is None else now, days)
