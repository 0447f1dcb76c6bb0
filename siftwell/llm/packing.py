"""Best-fit packing of documents into sequences of bounded length (operator 5).

Method: pattern packing. Lengths are counted; patterns of two to four lengths that fill a sequence are
enumerated; non-negative least squares fits how often each pattern is used to the histogram; the counts
are rounded down and what they leave is packed best-fit. The plan depends on the histogram alone (at most
``capacity`` numbers), never on the number of documents: it is a table of runs "pieces number a to b of
this length go to sequences s, s+1, ... at offset o". The documents meet it by (length, number).
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import each_text, per_batch, stored, trim
from siftwell.llm.vocab import ByteLevel, read_bytes

CAPACITY = 2048
#: Pieces of one length are numbered in this many parts, so that no length is numbered by one task.
PARTS = 128


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0,
                 with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, each document ended by ``end_id``.

    ``docs``: doc_id, text (null counts as empty), any other columns are dropped. Only documents longer
    than ``capacity`` are cut, into full pieces and a first piece with the rest. Returns doc_id, piece,
    start, length, ids_crc32 and, if asked for, ids. A repeated doc_id is a document of its own; an empty
    text is one piece of length 1; an empty table gives no rows.
    """
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(read_bytes(vocabulary))
    added = "pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + \
        (",ids:array<int>" if with_ids else "") + ">>"

    def make():
        coder = ByteLevel(file.value, pattern)
        trim()  # reading the vocabulary takes more memory than it fills
        end = np.array([end_id], "<u4")

        def work(batch):
            rows = []
            for text in each_text(batch):
                ids = np.concatenate([coder.ids(text), end]).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                row = []
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    one = {"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())}
                    row.append(one | ({"ids": ids[a:b].astype("i4")} if with_ids else {}))
                rows.append(row)
            return {"pieces": rows}

        return work

    cut = per_batch(docs.select("doc_id", "text"), make, added, keep=["doc_id"], tidy=True)
    return cut.select("doc_id", F.inline("pieces"))


def enumerate_patterns(lengths: np.ndarray, capacity: int, fan: int = 8) -> np.ndarray:
    """Patterns of two to four of the ``lengths`` that add up to ``capacity``; rows padded with 0.

    All pairs; for each length up to ``fan`` triples and ``fan`` quadruples, their middle lengths spread
    evenly over those that fit, so the number of patterns grows with the number of lengths only.
    """
    have, found = set(map(int, lengths)), set()
    ordered = sorted(have)

    def spread(most: int) -> list[int]:
        n = bisect.bisect_right(ordered, most)
        return [ordered[i] for i in sorted({round(x) for x in np.linspace(0, n - 1, min(fan, n))})] if n else []

    for a in ordered:
        if capacity - a in have:
            found.add(tuple(sorted((a, capacity - a))))
        for b in spread(capacity - a - 1):
            if capacity - a - b in have:
                found.add(tuple(sorted((a, b, capacity - a - b))))
            rest = capacity - a - b
            for c in spread(rest - 1)[1:-1:2]:
                if rest - c in have:
                    found.add(tuple(sorted((a, b, c, rest - c))))
    table = np.zeros((len(found), 4), int)
    for row, pattern in zip(table, sorted(found)):
        row[: len(pattern)] = pattern
    return table


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of pattern counts to the histogram, by projected gradient steps that are
    scaled by row and column sums. There are many equal fits; starting from full pairs finds one that
    keeps short documents for where they are needed."""
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    a, b, third = patterns[:, 0], patterns[:, 1], patterns[:, 2]
    x = np.where(third == 0, np.where(a == b, histogram[a] // 2, np.minimum(histogram[a], histogram[b])), 0.0)
    used = patterns > 0
    per_length = np.bincount(patterns[used], minlength=len(histogram)).astype(float)
    per_length[per_length == 0] = 1
    per_length[0] = 1
    size = used.sum(1)
    for _ in range(rounds):
        fitted = np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), minlength=len(histogram))
        gap = (histogram - fitted) / per_length
        gap[0] = 0
        x = np.maximum(0, x + 1.8 * gap[patterns].sum(1) / size)
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, how many, first sequence, offset) that place every piece counted."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    runs, placed, sequences = [], np.zeros(capacity + 1, np.int64), 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, int(placed[length]), n, sequence, offset))
        placed[length] += n

    if counts[capacity]:
        put(capacity, int(counts[capacity]), 0, 0)
        sequences = int(counts[capacity])
    patterns = enumerate_patterns(np.flatnonzero(counts[1:capacity]) + 1, capacity)
    fitted = np.floor(fit_counts(patterns, np.where(np.arange(capacity + 1) < capacity, counts, 0).astype(float)))
    for k in np.argsort(-fitted, kind="stable"):
        if fitted[k] < 1:
            break
        need = defaultdict(int)
        for length in patterns[k][patterns[k] > 0]:
            need[int(length)] += 1
        n = min(int(fitted[k]), *(int(counts[ln] - placed[ln]) // m for ln, m in need.items()))
        if n:
            offset = 0
            for length in sorted((int(v) for v in patterns[k] if v), reverse=True):
                put(length, n, sequences, offset)
                offset += length
            sequences += n

    # What is left: longest first, each into the fullest sequences it fits in.
    room: dict[int, list[list[int]]] = defaultdict(list)  # free tokens -> [first sequence, how many]
    frees: list[int] = []

    def opened(free: int, sequence: int, n: int) -> None:
        if free and n:
            if not room[free]:
                bisect.insort(frees, free)
            room[free].append([sequence, n])

    for length in range(capacity - 1, 0, -1):
        left = int(counts[length] - placed[length])
        while left:
            at = bisect.bisect_left(frees, length)
            if at == len(frees):
                each = capacity // length
                n, odd = divmod(left, each)
                if n == 0:
                    each, n, odd = left, 1, 0
                for k in range(each):
                    put(length, n, sequences, k * length)
                opened(capacity - each * length, sequences, n)
                sequences += n
                left = odd
                continue
            free = frees[at]
            sequence, n = room[free].pop()
            if not room[free]:
                frees.pop(at)
            each = min(free // length, left)
            take = min(n, left // each)
            for k in range(each):
                put(length, take, sequence, capacity - free + k * length)
            opened(free - each * length, sequence, take)
            opened(free, sequence + take, n - take)
            left -= take * each
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY, parts: int = PARTS) -> DataFrame:
    """``pieces`` (doc_id, piece, length from 1 to ``capacity``, any more columns) with sequence_id and offset.

    ``pieces`` must be stored, as it is read twice. The driver gets one number for each length and part
    (at most ``capacity`` x ``parts``) and sends back that many numbers and the plan. Pieces that are equal
    in doc_id, piece and length may swap places; nothing else depends on the order of rows.
    """
    spark = pieces.sparkSession
    keyed = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counted = sorted((r["length"], r["_part"], r["count"]) for r in keyed.groupBy("length", "_part").count().collect())
    histogram, before = defaultdict(int), []
    for length, part, n in counted:
        before.append((length, part, histogram[length]))
        histogram[length] += n
    firsts = spark.createDataFrame(before, "_length bigint, _at int, _before bigint")
    runs = spark.createDataFrame(plan(histogram, capacity),
                                 "_run_length bigint, _first bigint, _many bigint, _sequence bigint, _offset bigint")
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    numbered = keyed.withColumn("_row", F.row_number().over(order) - 1).join(
        F.broadcast(firsts), (F.col("length") == F.col("_length")) & (F.col("_part") == F.col("_at"))) \
        .withColumn("_number", F.col("_row") + F.col("_before"))
    inside = (F.col("length") == F.col("_run_length")) & (F.col("_number") >= F.col("_first")) & \
        (F.col("_number") < F.col("_first") + F.col("_many"))
    return numbered.join(F.broadcast(runs), inside).select(
        *pieces.columns, (F.col("_sequence") + F.col("_number") - F.col("_first")).alias("sequence_id"),
        F.col("_offset").alias("offset"))


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents and their places; see ``token_pieces`` and ``place``."""
    return place(stored(token_pieces(docs, vocabulary, pattern, capacity), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves (sequence_id, ids, doc_ids, offsets) of placed pieces with ids.

    A group holds at most ``capacity`` ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"))
