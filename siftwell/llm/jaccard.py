"""Near-duplicates by SimHash and exact Jaccard similarity of five-word shingles, 0.8 or more (the pipeline's
stage).

Texts are sets of shingle hashes. First comes operator 3's method on them: 64-bit fingerprints, Hamming code
anchors and spanning links find sets whose fingerprints differ in at most three bits, and the whole sets of
each link are compared. A fingerprint does not see every pair of a similarity of 0.8, so a prefix filter
follows: two sets that are similar enough share an element among the first n - ceil(0.8 n) + 1 of each in any
one order, so only those few are dealt and no similar pair is missed. The order puts shingles that many texts
hold last. It comes from counts in a table of fixed size, which orders only and decides nothing.

Only sets of one block that fingerprints left in different parts go on, in two rounds that compare whole
sets. First each meets a few of the block's, which joins large groups without comparing all with all. Then
only texts that still lie in different parts are paired. Sets are larger than their texts, so they are worked
out again where they are needed, never stored for all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import forget, per_batch, released, stored, texts, whole, with_row
from siftwell.llm.simhash import SEED, UPPER, components, links, majority

SHINGLE = 5
#: The least similarity, as a fraction of integers.
LEAST = (4, 5)
BUCKETS = 1 << 20
#: Texts of a block that all others of it meet in the first round.
HUBS = 6
#: Cells of ``counts``, by the upper seven bits of a hash.
CELLS = 128
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of all runs of five words; a shorter text is one run, an empty one has none."""
    words = text.encode("utf-8", "surrogatepass").translate(UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in words], np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, min(len(words), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = (out ^ hashes[k:k + n]) * FACTOR
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def key(hashes: np.ndarray) -> int:
    """The id of a set: equal sets are one class."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def counts(hashes: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of ``CELLS``; two sets share no more than the lesser counts."""
    return np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=CELLS).astype("<u4")


def may_be_similar(a: np.ndarray, b: np.ndarray) -> bool:
    """False only where the ``counts`` of two sets leave no room for a similarity of 0.8."""
    both = int(np.minimum(a, b).sum(dtype=np.int64))
    return LEAST[1] * both >= LEAST[0] * (int(a.sum(dtype=np.int64)) + int(b.sum(dtype=np.int64)) - both)


def with_ids(docs: DataFrame) -> DataFrame:
    """doc_id, _t (hash of the text), _id of the set, _fp (its fingerprint), _counts."""
    def make():
        def work(batch):
            sets = [shingles(t) for t in texts(batch)]
            return {"_id": [key(s) for s in sets], "_fp": [majority(s) for s in sets], "_counts": [counts(s).tobytes() for s in sets]}

        return work

    rows = docs.select("doc_id", "text", F.xxhash64(whole(F.col("text"))).alias("_t"))
    return per_batch(rows, make, "_id bigint, _fp bigint, _counts binary", keep=["doc_id", "_t"], tidy=True)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def levels(docs: DataFrame) -> np.ndarray:
    """For each bucket of hashes, the bit length of the number of shingles in it."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in texts(batch):
                np.add.at(total, bucket(shingles(text)), 1)
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 100_000):
            part = seen[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), pa.array(total[part])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(released(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    out[rows.column("bucket").to_numpy()] = np.ceil(np.log2(rows.column("n").to_numpy() + 1)).astype(np.uint8)
    return out


def prefixes(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """token, _id, size, at: the first shingles of each set and their places in its order; sets that occur
    several times may do so here."""
    shipped = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        first = shipped.value
        for batch in batches:
            # copies that lie together are looked at once
            sets = {key(s): s for s in map(shingles, set(texts(batch)))}
            out = []
            for hashes in sets.values():
                n = len(hashes)
                keep = n - (LEAST[0] * n + LEAST[1] - 1) // LEAST[1] + 1 if n else 0
                out.append(hashes[np.lexsort((hashes, first[bucket(hashes)]))[:keep]])
            lengths = np.array([len(x) for x in out], np.int64)
            if lengths.sum():
                ids, sizes = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], "i4")
                tokens = np.concatenate(out).view(np.int64)
                at = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens), pa.array(np.repeat(ids, lengths)), pa.array(np.repeat(sizes, lengths)),
                     pa.array(at.astype("i4"))], names=["token", "_id", "size", "at"])

    return docs.select("text").mapInArrow(released(run), "token bigint, _id bigint, size int, at int")


def sets_of(needed: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """_id and _set of the set ids in ``needed``, from one text of each."""
    one = stored(ids.join(needed, "_id", "left_semi").groupBy("_id").agg(F.min("_t").alias("_t")), "texts")
    found = docs.select("text", F.xxhash64(whole(F.col("text"))).alias("_t")).join(one, "_t") \
        .groupBy("_id").agg(F.first("text").alias("text"))
    return per_batch(found, lambda: lambda batch: {"_set": [shingles(t).tobytes() for t in texts(batch)]},
                     "_set binary", keep=["_id"], tidy=True)


def passing(pairs: DataFrame, held: DataFrame, name: str, dtype: str, test) -> DataFrame:
    """Those of ``pairs`` (a, b) whose values in ``held`` (_id and the binary column ``name``) pass ``test``."""
    def run(batches):
        for batch in batches:
            good = [test(np.frombuffer(x.as_buffer(), dtype), np.frombuffer(y.as_buffer(), dtype))
                    for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sides = pairs.join(held.select(F.col("_id").alias("a"), F.col(name).alias("x")), "a") \
        .join(held.select(F.col("_id").alias("b"), F.col(name).alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(released(run), "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of stored ``pairs`` (a, b) of set ids that are similar enough. Pairs that their counts rule out
    leave first, so whole sets are moved for few others."""
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "needed")
    brief = stored(ids.select("_id", "_counts").join(needed, "_id", "left_semi").dropDuplicates(["_id"]), "counts")
    maybe = stored(passing(pairs, brief, "_counts", "<u4", may_be_similar), "maybe")
    forget(brief)
    needed = stored(maybe.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "needed")
    held = stored(sets_of(needed, docs, ids), "held")
    found = stored(passing(maybe, held, "_set", "<u8", similar), "edges")
    forget(held)
    return found


def alike(ids: DataFrame) -> DataFrame:
    """a, b: sets whose fingerprints are equal or linked, each fingerprint by the smallest of its sets."""
    marked = stored(ids.select("_id", "_fp").distinct(), "fingerprints")
    heads = stored(marked.groupBy("_fp").agg(F.min("_id").alias("head")), "heads")
    near = links(heads.select("_fp"))
    for side in ("a", "b"):
        near = near.join(heads.select(F.col("_fp").alias(side), F.col("head").alias(f"{side}_head")), side)
    equal = marked.join(heads, "_fp").where("_id != head").select(F.col("head").alias("a"), F.col("_id").alias("b"))
    return near.select(F.col("a_head").alias("a"), F.col("b_head").alias("b")).unionAll(equal)


def possible(size: Column, at: Column, other_size: Column, other_at: Column) -> Column:
    """Two sets whose first common shingle is at these places may be similar enough: their sizes are near
    enough, and the places leave room for as many common ones as they need."""
    sizes = LEAST[1] * F.least(size, other_size) >= LEAST[0] * F.greatest(size, other_size)
    room = F.least(size - at, other_size - other_at)
    return sizes & ((LEAST[0] + LEAST[1]) * room >= LEAST[0] * (size + other_size))


def met(held: DataFrame, hubs: DataFrame) -> DataFrame:
    """a, b: each set of a block with those of the block's hubs that lie in other parts, where they may be
    similar enough."""
    both = held.join(hubs, "token").select("_id", "size", "at", "part", F.explode("hubs").alias("hub"))
    return both.where((F.col("part") != F.col("hub.part")) & possible(
        F.col("size"), F.col("at"), F.col("hub.size"), F.col("hub.at"))) \
        .select(F.least("_id", "hub._id").alias("a"), F.greatest("_id", "hub._id").alias("b")).distinct()


def in_parts(held: DataFrame, near: DataFrame) -> DataFrame:
    """``held`` of blocks whose sets ``near`` leaves in different parts, with their part."""
    parts = held.join(components(near), F.col("_id") == F.col("node"), "left") \
        .withColumn("part", F.coalesce("root", "_id")).drop("node", "root")
    parts = stored(parts, "parts")
    mixed = parts.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("token")
    left = stored(parts.join(mixed, "token", "left_semi"), "open")
    forget(parts)
    return left


def edges(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """a, b: links between distinct sets that connect all pairs of a similarity of 0.8 or more.

    Shingles in one set only are dropped first, which are nearly all. A set of which copies were made
    shares all of its shingles with them, a changed copy does not; so the set whose share of shared
    shingles is largest is a hub of its blocks, beside a few dealt by hash.
    """
    near = verified(stored(alike(ids), "alike"), docs, ids)
    entries = stored(prefixes(docs, levels(docs)), "prefixes")
    shared = entries.groupBy("token").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low != high")
    held = stored(entries.join(shared.select("token"), "token", "left_semi").distinct(), "shared")
    forget(entries)
    # of n shingles, the prefix holds a fifth and one
    share = F.count("*") / (F.first("size") / LEAST[1] + 1)
    rich = stored(held.groupBy("_id").agg(share.alias("share")), "rich")
    mixed = in_parts(held, near)
    forget(held)
    one = F.struct("_id", "size", "at", "part")
    rated = stored(mixed.join(rich, "_id"), "rated")
    fixed = [F.max_by(one, F.struct("share", F.xxhash64("_id"))), F.max_by(one, F.struct("share", F.xxhash64("_id", F.lit(1))))]
    hubs = F.array_distinct(F.array(*fixed, *(F.min_by(one, F.xxhash64("_id", F.lit(k))) for k in range(HUBS - len(fixed)))))
    stars = stored(met(rated, rated.groupBy("token").agg(hubs.alias("hubs"))), "stars")
    forget(rated)
    near = near.unionAll(verified(stars, docs, ids))
    left = in_parts(mixed.drop("part"), near)
    right = left.select("token", *(F.col(c).alias(f"{c}_2") for c in ("_id", "size", "at", "part")))
    rest = left.join(right, "token").where(
        (F.col("part") < F.col("part_2")) & possible(F.col("size"), F.col("at"), F.col("size_2"), F.col("at_2"))) \
        .select(F.col("_id").alias("a"), F.col("_id_2").alias("b")).distinct()
    return near.unionAll(verified(stored(rest, "rest"), docs, ids))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay when one of each component does: the row with the component's smallest
    doc_id, rows without one last; of rows that repeat it, the one with the smallest set and text.

    Components are told apart by their root, so a doc_id that repeats in two of them stays in both. Texts
    without a word are one component. All columns are kept.
    """
    sets = stored(with_ids(docs), "ids")
    roots = components(edges(docs, sets))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_id", "_t")
    best = stored(sets.select("doc_id", "_id", "_t").join(roots, F.col("_id") == F.col("node"), "left")
                  .groupBy(F.coalesce("root", "_id").alias("part"))
                  .agg(F.min(rank).alias("r")).select("r.doc_id", "r._t"), "best")
    counted = sets.groupBy("doc_id", "_t").agg(F.count("*").alias("n"))
    chosen = best.select(F.col("doc_id").alias("d"), F.col("_t").alias("t"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_t") == F.col("t"))
    # few rows leave or repeat: those are looked up, the others pass without being moved
    marked = counted.join(chosen, same, "left").select("doc_id", "_t", "n", F.col("t").isNotNull().alias("stays"))
    marked = stored(marked.where("not stays or n > 1"), "marked")
    special = marked.select(F.col("doc_id").alias("d"), F.col("_t").alias("t"), "stays")
    rows = with_row(docs, "doc_id", F.xxhash64(whole(F.col("text"))).alias("_t"))
    alone = rows.join(special, same, "left_anti").select("_row.*")
    repeated = rows.join(special.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "_t"]).select("_row.*")
    return alone.unionAll(repeated)
