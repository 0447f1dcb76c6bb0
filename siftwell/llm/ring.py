"""Consistent-hash ring with virtual nodes and bounded loads (operator 1); DataFrame functions only.

The ring has 65,536 points. Each shard stands on it with ``VIRTUAL`` virtual nodes; a row's key hashes to a
point and belongs to the next node clockwise. Shards hold at most their capacity: rows a full shard
cannot take go on clockwise to the next node of a shard with room. Capacities add up to the number of
rows (times ``1 + slack``), so the balance is a guarantee: with slack 0 any two shards differ by one row
at most. Rows whose shard has room never move, so adding a shard moves little more than that shard's part.

Only row counts of the ring's points leave the executors, 65,536 numbers whatever the input; where a
point's rows go is planned from them and sent back as a table of that size.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS = 1 << 16
VIRTUAL = 128


def nodes(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes, clockwise. A shard's nodes do not depend on the others; of two
    on one point the lower shard comes first."""
    def point(shard: int, k: int) -> int:
        return int.from_bytes(hashlib.md5(f"shard {shard} node {k}".encode()).digest()[:8], "big") % POINTS

    return sorted((point(s, k), s) for s in range(shards) for k in range(virtual))


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Equal parts of ``rows``, the first ones larger by one where it does not divide; with slack, a
    ``slack`` share more for each."""
    even = [rows // shards + (s < rows % shards) for s in range(shards)]
    return even if slack <= 0 else [c + int(slack * rows / shards) + 1 for c in even]


def plan(counts: dict[int, int], shards: int, slack: float = 0.0, virtual: int = VIRTUAL) -> list[tuple[int, int, int, int, int]]:
    """Runs (point, first row, how many, shard, first slot) for the rows counted at each point.

    Home rows go first, so a shard is filled by its own rows before it takes any from others; then what
    is left over goes on clockwise, point by point.
    """
    ring = nodes(shards, virtual)
    places = [p for p, _ in ring]
    room = capacities(sum(counts.values()), shards, slack)
    filled, runs, over = [0] * shards, [], []

    def put(point: int, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            runs.append((point, first, n, shard, filled[shard]))
            filled[shard] += n
            room[shard] -= n
        return n

    for point in sorted(counts):
        node = bisect_left(places, point) % len(ring)
        taken = put(point, 0, counts[point], ring[node][1])
        if taken < counts[point]:
            over.append((point, taken, node))
    after = list(range(1, len(ring) + 1))  # next node to try, skipping nodes of full shards

    def following(node: int) -> int:
        seen = []
        at = after[node] % len(ring)
        while not room[ring[at][1]]:
            seen.append(at)
            at = after[at] % len(ring)
        for k in (node, *seen):
            after[k] = at
        return at

    for point, taken, node in over:
        while taken < counts[point]:
            node = following(node)
            taken += put(point, taken, counts[point] - taken, ring[node][1])
    return runs


def assign(rows: DataFrame, key: str, shards: int, tie: list[str], slack: float = 0.0) -> DataFrame:
    """``rows`` with shard (from 0) and slot (its place in the shard, gapless from 0).

    ``key`` is the column that is hashed; null keys hash as a value of their own. ``tie`` are columns that
    order rows of one point beside the key; rows equal in all of them may swap slots. An empty table
    stays empty; columns called shard or slot are replaced. ``rows`` is read twice; keep texts out of it, as its rows are moved once.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = rows.sparkSession
    # High bits choose the point, all bits the order in it. Null gets the hash of a text no key casts to.
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    hashed = rows.select(F.struct(*kept).alias("_row"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null key"))).alias("_hash"))
    hashed = hashed.withColumn("_point", F.shiftrightunsigned("_hash", 48).cast("int"))
    counts = {r["_point"]: r["count"] for r in hashed.groupBy("_point").count().collect()}
    runs = spark.createDataFrame(plan(counts, shards, slack),
                                 "_at int, _first bigint, _many bigint, shard int, _slot bigint")
    order = Window.partitionBy("_point").orderBy("_hash", *(F.col("_row")[c] for c in [key, *tie]))
    inside = (F.col("_point") == F.col("_at")) & (F.col("_nth") >= F.col("_first")) & \
        (F.col("_nth") < F.col("_first") + F.col("_many"))
    return hashed.withColumn("_nth", F.row_number().over(order) - 1).join(F.broadcast(runs), inside).select(
        "_row.*", "shard", (F.col("_slot") + F.col("_nth") - F.col("_first")).alias("slot"))
