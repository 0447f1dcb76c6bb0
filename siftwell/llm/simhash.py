"""Near-duplicates by SimHash, found by anchor-point covering (operator 3).

A fingerprint has 64 bits, one of two halves of which differs in at most one bit when two fingerprints
differ in at most three. The anchors of a half are the words of the perfect Hamming code on 31 of its bits:
every value is within one bit (the covering radius) of exactly one anchor, its home. Each fingerprint is
replicated to all anchors within two bits, the covering radius plus the half's threshold: 16 of 2^26. A
value within one bit of another is within two of the other's home, so they meet there and are compared.

Equal fingerprints are one class throughout; only distinct ones are replicated, compared and linked, and
an anchor emits a spanning forest of its links, never all pairs. Components are found by passing smallest
labels along links, with every round written to the shared folder.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import per_batch, stored, texts, with_row

SHINGLE = 3
SEED = 42
THRESHOLD = 3
#: Anchors with more fingerprints are compared in blocks of this many, each pair of blocks by itself.
BLOCK = 2048

UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def majority(values: np.ndarray) -> int:
    """The bits set in over half of unsigned 64-bit hashes, as a signed integer; zero where there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):
        part = values[at:at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<i8")[0])


def fingerprint(text: str) -> int:
    """The fingerprint as a signed 64-bit integer. Empty texts have fingerprint zero."""
    words = text.encode().translate(UPPER).split()  # bytes split at blanks and tab to carriage return only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    return majority(np.array(hashes, "<u8"))


def with_fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with _fp; a null text counts as empty."""
    def make():
        return lambda batch: {"_fp": [fingerprint(t) for t in texts(batch)]}

    return per_batch(docs, make, "_fp bigint", keep=keep)


def syndrome(half: Column) -> Column:
    """Which of the bits 1 to 31 must flip to reach the nearest code word; 0 if none."""
    bits = [(F.bit_count(half.bitwiseAND(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1))) % 2) * (1 << k)
            for k in range(5)]
    return sum(bits[1:], bits[0])


def anchors(classes: DataFrame) -> DataFrame:
    """side, anchor, _fp, home for every anchor of every distinct fingerprint.

    Two flips i and j lead to a code word when their positions' exclusive or is the syndrome; one flip
    leads home. From a code word itself no other is within two bits.
    """
    sides = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("_fp").bitwiseAND(0x7FFFFFFF).alias("half")),
        F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("_fp", 32).bitwiseAND(0x7FFFFFFF).alias("half"))))
    half, at = F.col("half"), F.col("_at")

    def bit(position: Column) -> Column:
        return F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (position - 1).cast("int"))) \
            .otherwise(F.lit(0).cast("bigint"))

    pairs = F.transform(
        F.filter(F.array(*map(F.lit, range(1, 32))), lambda i: (at > 0) & (i < i.bitwiseXOR(at))),
        lambda i: F.struct(half.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(at))).alias("anchor"), F.lit(False).alias("home")))
    home = F.array(F.struct(half.bitwiseXOR(bit(at)).alias("anchor"), F.lit(True).alias("home")))
    return classes.select("_fp", sides.alias("s")).select("_fp", "s.*").withColumn("_at", syndrome(half)) \
        .select("_fp", "side", F.explode(F.concat(home, pairs)).alias("a")).select("side", "a.anchor", "_fp", "a.home")


def forest(left: np.ndarray, right: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that join all of ``left`` and ``right`` that are within ``threshold`` bits, without circles.

    Each row of ``left`` is compared with all of ``right`` at once; of a whole row of links only those
    that join two parts are kept.
    """
    values, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    part = np.arange(len(values))
    a_ids, b_ids = inverse[: len(left)], inverse[len(left):]
    links = []
    for value, a in zip(left, a_ids):
        near = b_ids[np.bitwise_count(right ^ value) <= threshold]
        for b in near[part[near] != part[a]]:
            if part[b] != part[a]:
                links.append((int(values[a].view(np.int64)), int(values[b].view(np.int64))))
                part[part == part[b]] = part[a]
    return links


def links(classes: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all within ``threshold`` bits of each other.

    Anchors that hold one fingerprint are dropped at once. One that holds very many is cut into blocks:
    each home block meets each block of all its fingerprints in a cell of its own.
    """
    at = Window.partitionBy("side", "anchor")
    held = anchors(classes).withColumn("_n", F.count("*").over(at)).withColumn("_homes", F.sum(F.col("home").cast("int")).over(at)) \
        .where((F.col("_n") > 1) & (F.col("_homes") > 0))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.hash("_fp"), blocks)
    every = F.sequence(F.lit(0), blocks - 1)
    as_home = held.where("home").select("side", "anchor", own.alias("row"), F.explode(every).alias("column"), F.lit(True).alias("home"), "_fp")
    as_any = held.select("side", "anchor", F.explode(every).alias("row"), own.alias("column"), F.lit(False).alias("home"), "_fp")
    cell = ["side", "anchor", "row", "column"]
    dealt = as_home.unionAll(as_any).repartition(*cell).sortWithinPartitions(*cell)

    def run(batches):
        def solve(keys: np.ndarray, homes: np.ndarray, fps: np.ndarray):
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            found = []
            for lo, hi in zip([0, *edges], [*edges, len(keys)]):
                home, any_ = fps[lo:hi][homes[lo:hi]], fps[lo:hi][~homes[lo:hi]]
                if len(home) and len(any_):
                    found += forest(home, any_, threshold)
            if found:
                table = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["a", "b"])

        held_back = None  # the last cell may go on in the next batch; a cell is bounded by two blocks
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in cell], 1)
            homes = batch.column("home").to_numpy(zero_copy_only=False)
            fps = batch.column("_fp").to_numpy().view(np.uint64)
            if held_back is not None:
                keys, homes, fps = (np.concatenate([x, y]) for x, y in zip(held_back, (keys, homes, fps)))
            if not len(keys):
                continue
            same = (keys == keys[-1]).all(1)
            last = len(keys) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from solve(keys[:last], homes[:last], fps[:last])
            held_back = keys[last:], homes[last:], fps[last:]
        if held_back is not None:
            yield from solve(*held_back)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node (signed) reachable from each node of ``edges`` (a, b).

    Rounds of large-star and small-star steps: every round each node's neighbours are linked to the
    smallest one seen from it, until nothing changes; the number of rounds grows with the logarithm of
    the longest chain. Each round is written to the shared folder.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    current = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                     .where("u != v").distinct(), "links")
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = smallest(both).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(best, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "large-star")
        low = smallest(large)
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")) \
            .select("p.u", "p.v").where("u != v").distinct()
        small = stored(small, "small-star")
        signature = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))]
        if tuple(small.agg(*signature).head()) == tuple(current.agg(*signature).head()):
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        current = small


def components_of(fingerprints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """_fp, component_id, root for every distinct _fp of stored ``fingerprints`` (doc_id, _fp).

    component_id is the smallest doc_id of all documents linked to one another, itself included; null
    only where none of them has one.
    """
    classes = stored(fingerprints.groupBy("_fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("_fp"), threshold))
    named = stored(classes.join(roots, F.col("_fp") == F.col("node"), "left")
                   .select("_fp", "first", "node", F.coalesce("root", "_fp").alias("root")), "roots")
    linked = named.join(named.where("node is not null").select(F.col("root").alias("r")).distinct(), F.col("root") == F.col("r"), "left_semi")
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    return named.join(smallest, "root", "left").select("_fp", F.coalesce("least", "first").alias("component_id"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row for each row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other; texts of one or two words
    hash whole; repeated rows share a component; an empty table gives no rows; more columns are dropped.
    """
    marked = stored(with_fingerprints(docs.select("doc_id", "text"), keep=["doc_id"]), "fingerprints")
    found = stored(components_of(marked), "components")
    return marked.join(found, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay when one of each component does: the row whose doc_id is the component's
    smallest; of rows that repeat it, the one with the smallest fingerprint and text. All columns are kept.

    A doc_id that repeats in two components stays in both; documents whose component has no doc_id at all
    are told apart by fingerprint.
    """
    marked = with_fingerprints(with_row(docs, "doc_id", "text"), keep=["doc_id", "_row"])
    pairs = stored(marked.select("doc_id", "_fp"), "fingerprints")
    found = components_of(pairs)
    stays = pairs.join(found, "_fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))) \
        .groupBy("component_id", "root", F.when(F.col("component_id").isNull(), F.col("_fp")).alias("_own")) \
        .agg(F.min("_fp").alias("_stay")).select(F.col("component_id").alias("_id"), "_stay")
    kept = marked.join(stays, (F.col("_fp") == F.col("_stay")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_fp"]).select("_row.*")
