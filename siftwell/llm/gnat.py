"""Product codes of vectors, nearest entries found by GNATs over the codebooks (operator 12).

A geometric near-neighbour access tree holds a few split points at each node; every other entry belongs to
its nearest split point, and for each split point and each child the range of distances between them is
kept. A vector's distances to the split points then rule out whole children: by the triangle inequality
nothing in a child is nearer than the gap between the vector's distance and the child's range. Floating
bounds are rounded outwards and a child is left out only if the gap is strictly larger than the best
distance so far; distances themselves are integers, so ties go to the lower index exactly.

Spark reads the vectors once a round; a task hands on sums and counts for each entry, 8 x 16 rows however
many vectors it saw, so what a round moves and what the driver holds is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import per_batch

#: Fixed values of the code: parts of a vector, entries of a codebook, rounds, and what a component is scaled by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components lie below this in size, so squared distances fit a long; larger ones are an error.
LARGEST = 1 << 28
SPLITS, LEAF = 4, 3
#: Vectors a task codes at a time.
ROWS = 4096


def complete(vector: Column) -> Column:
    """Not null, not empty, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def squares(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances as integers, row by entry."""
    out = np.zeros((len(queries), len(entries)), np.int64)
    for j in range(queries.shape[1]):
        gap = queries[:, j, None] - entries[None, :, j]
        out += gap * gap
    return out


def below(squared: np.ndarray) -> np.ndarray:
    """A bound that is not above the root of an integer."""
    root = np.sqrt(squared.astype(float))
    return np.where(squared > 0, np.nextafter(np.nextafter(root, 0), 0), 0.0)


def above(squared: np.ndarray) -> np.ndarray:
    """A bound that is not below the root of an integer."""
    root = np.sqrt(squared.astype(float))
    return np.nextafter(np.nextafter(root, np.inf), np.inf)


@dataclass
class Node:
    splits: np.ndarray           # indices of the split points; all entries of a leaf
    children: list               # a Node or None under each split point
    least: np.ndarray | None     # [i, c]: bounds of the distances from split point i to what child c holds
    most: np.ndarray | None


class Gnat:
    """The tree over one codebook. Equal entries are one, the lowest index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        first = {}
        for i, entry in enumerate(map(tuple, entries.tolist())):
            first.setdefault(entry, i)
        self.root = self.build(np.array(sorted(first.values()), np.int64))

    def build(self, items: np.ndarray) -> Node:
        if len(items) <= LEAF:
            return Node(items, [], None, None)
        far = squares(self.entries[items], self.entries[items])
        chosen = [0]  # each next split point is the one farthest from those before
        while len(chosen) < min(SPLITS, len(items)):
            chosen.append(int(far[:, chosen].min(1).argmax()))
        owner = far[:, chosen].argmin(1)
        least, most = np.zeros((len(chosen),) * 2), np.zeros((len(chosen),) * 2)
        children = []
        for c in range(len(chosen)):
            held = np.setdiff1d(np.flatnonzero(owner == c), chosen)
            children.append(self.build(items[held]) if len(held) else None)
            if len(held):
                least[:, c] = below(far[np.ix_(chosen, held)].min(1))
                most[:, c] = above(far[np.ix_(chosen, held)].max(1))
        return Node(items[chosen], children, least, most)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each query's nearest entry, ties to the lower index; and how many
        distances were worked out."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        which = np.full(len(queries), len(self.entries))
        seen = 0

        def visit(node: Node, ask: np.ndarray) -> None:
            nonlocal seen
            far = squares(queries[ask], self.entries[node.splits])
            seen += far.size
            for c, entry in enumerate(node.splits.tolist()):
                better = (far[:, c] < best[ask]) | ((far[:, c] == best[ask]) & (entry < which[ask]))
                best[ask[better]], which[ask[better]] = far[better, c], entry
            if not node.children:
                return
            low, high = below(far), above(far)
            for c, child in enumerate(node.children):
                if child is not None:
                    gap = np.maximum(low - node.most[None, :, c], node.least[None, :, c] - high).max(1)
                    # the difference of two bounds may be rounded up by one step
                    stays = np.nextafter(gap, -np.inf) <= above(best[ask])
                    if stays.any():
                        visit(child, ask[stays])

        if len(queries) and len(self.entries):
            visit(self.root, np.arange(len(queries)))
        return which, best, seen


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(SCALE x) as integers."""
    out = np.floor(values.astype(float) * SCALE)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} or more in size can't be coded exactly")
    return out.astype(np.int64)


def blocks(batch: pa.RecordBatch, width: int):
    """Scaled vectors of a batch, so many at a time, with the place of the first."""
    column = batch.column("_v")
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        yield at, scaled(part.flatten().to_numpy(zero_copy_only=False)).reshape(len(part), PARTS, width)


def trees(books: np.ndarray) -> list[Gnat]:
    return [Gnat(book) for book in books]


def usable(vectors: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows of ``vectors`` that take part, with their vector as _v, and its length.

    Where lengths differ, those of the most common one take part (the smallest of equally common ones)."""
    rows = vectors.where(complete(F.col(vector))).withColumn("_v", F.col(vector))
    width = rows.select(F.mode(F.size("_v"), True)).head()[0]
    if not width:
        return rows, 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    return rows.where(F.size("_v") == width), width


def first_entries(rows: DataFrame, key: str, entries: int) -> np.ndarray:
    """Scaled vectors of the smallest keys, ascending; of rows that repeat a key, the smallest vector. Rows
    without a key start no entry."""
    def run(batches):
        held: set = set()
        for batch in batches:
            held.update(x for x in batch.column(0).to_pylist() if x is not None)
            held = set(sorted(held)[:entries])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(held), pa.int64())], names=["k"])

    keys = rows.select(F.col(key).cast("bigint").alias("k"))
    least = [r["k"] for r in keys.mapInArrow(run, "k bigint").distinct().orderBy("k").limit(entries).collect()]
    found = rows.where(F.col(key).isin(least)).groupBy(key).agg(F.min("_v").alias("_v")).orderBy(key).collect() if least else []
    return scaled(np.array([r["_v"] for r in found])) if found else np.zeros((0, 0), np.int64)


def sums(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """For each part and entry, the sum of what is assigned to it by component, and last the count."""
    parts, entries, width = books.shape
    shipped = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        tree = trees(shipped.value)
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for _, block in blocks(batch, width):
                for p in range(parts):
                    which = tree[p].nearest(block[:, p])[0]
                    np.add.at(total[p, :, width], which, 1)
                    np.add.at(total[p, :, :width], which, block[:, p])
        used = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(total.ravel()[used])], names=["slot", "n"])

    # exact beyond a long: a task's sum fits one, those of all tasks need not
    got = rows.select("_v").mapInArrow(run, "slot int, n bigint") \
        .groupBy("slot").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    out = np.zeros(parts * entries * (width + 1), object)
    for r in got:
        out[r["slot"]] = int(r["n"])
    return out.reshape(parts, entries, width + 1)


def learn(rows: DataFrame, key: str, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks, (part, entry, component), after so many rounds over all ``rows``."""
    start = first_entries(rows, key, entries)
    books = start.reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    if not len(start):
        return books
    for _ in range(rounds):
        total = sums(rows, books)
        used = total[:, :, -1] > 0
        books[used] = (total[:, :, :-1][used] // total[:, :, -1:][used]).astype(np.int64)
    return books


def encode(rows: DataFrame, books: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` of ``rows`` with code (an index a part, as bytes) and error, the squared distances over all parts."""
    width = books.shape[2]
    shipped = rows.sparkSession.sparkContext.broadcast(books)

    def make():
        tree = trees(shipped.value)

        def work(batch):
            codes, errors = [], []
            for _, block in blocks(batch, width):
                found = [tree[p].nearest(block[:, p])[:2] for p in range(len(tree))]
                codes += [x.tobytes() for x in np.stack([w for w, _ in found], 1).astype(np.uint8)]
                errors += sum(e for _, e in found).tolist()
            return {"code": codes, "error": errors}

        return work

    return per_batch(rows, make, "code binary, error bigint", keep=keep, name="_v")


def compress(vectors: DataFrame, key: str, keep: list[str], vector: str = "embedding", entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``keep`` of the rows of ``vectors`` that take part, with code and error (``keep`` may not hold columns
    of these names), and the codebooks.

    Rows take part if their vector is not null, not empty, of the most common length, and holds neither null
    nor non-finite components. Repeated rows count as often as they occur but start one entry; with fewer
    different keys than ``entries`` there are fewer entries, and with none (an empty table, or all keys
    null) no row is coded. ``vectors`` is read once a round: store what is costly to work out.
    """
    if entries > 256:
        raise ValueError("an index has to fit a byte")
    rows, width = usable(vectors, vector)
    books = learn(rows, key, width, entries, rounds) if width else np.zeros((PARTS, 0, 0), np.int64)
    return encode(rows if books.shape[1] else rows.where("false"), books, keep), books


def written(books: np.ndarray) -> str:
    """All components by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))
