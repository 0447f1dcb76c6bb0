"""Byte-level BPE by Spark's higher-order functions, and back (operator 4).

Texts are cut into words, and these where no piece of the vocabulary could ever reach across. The distinct
parts of each block of documents become byte arrays. On each, ``aggregate`` folds the ranked merges: every
step joins the leftmost pair of lowest rank, which a literal rank map gives. The map is keyed by the two
pieces' ids.
Word ids are then laid out in document order. Nothing is moved between tasks: a block is a row.

Decoding concatenates the binary pieces of ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftwell.llm.vocab import read_bytes
from siftwell.session import bound_batches

#: Text of a block in characters, unless one document is longer. More text shares more words; it also is
#: what a row holds.
BLOCK_CHARS = 32 << 20
#: Bits of an id (17), and of an id with the bits of a place above it (28).
MASK, PIECE = (1 << 17) - 1, (1 << 45) - 1
#: Length of a slice up to the end.
REST = 1 << 30
#: A rank that stands for none; a state's value of that rank; an entry of the rank map that no pair has.
NONE, EMPTY = 1 << 17, 1 << 40
HIGH = NONE << 45
#: Patterns with no match that runs from another character to white space.
CUT_BY_SPACES = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


def read_ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of every pair of pieces that together are a piece."""
    return {(ranks[word[:k]], ranks[word[k:]]): i for word, i in ranks.items() for k in range(1, len(word))
            if word[:k] in ranks and word[k:] in ranks}


def out_of_reach(ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> dict[bytes, int]:
    """Pieces that merging their own bytes does not give; a word that is one of them is taken whole."""
    def merged(word: bytes) -> list[int]:
        ids = [ranks[bytes([b])] for b in word]
        while len(ids) > 1:
            least = min(pairs.get(p, NONE) for p in zip(ids, ids[1:]))
            if least == NONE:
                break
            at = next(i for i, p in enumerate(zip(ids, ids[1:])) if pairs.get(p, NONE) == least)
            ids[at:at + 2] = [least]
        return ids

    return {word: i for word, i in ranks.items() if merged(word) != [i]}


class Seams:
    """Places of words that no piece reaches across: merges on both sides never meet, so each side can be
    folded alone.

    A piece across a place is seen by its bytes: whole if it has up to four, else by five of them in a row
    that lie across. Tables are asked by a hash, so some seams are not found; those that are found are seams.
    """

    LONGEST, BITS, STEP = 5, 21, 1 << 16

    def __init__(self, ranks: dict[bytes, int]):
        self.tables = {}
        for n in range(2, self.LONGEST + 1):
            grams = {w[i:i + n] for w in ranks if len(w) == n or n == self.LONGEST for i in range(len(w) - n + 1)}
            rows = np.frombuffer(b"".join(grams), np.uint8).reshape(-1, n)
            self.tables[n] = np.zeros(1 << self.BITS, bool)
            self.tables[n][self.places(self.keys(rows.T)[-1])] = True

    @classmethod
    def keys(cls, columns) -> list[np.ndarray]:
        """The first byte, the first two, and so on, as numbers."""
        out = [np.zeros(0, np.uint64)]
        for k, column in enumerate(columns):
            higher = column.astype(np.uint64) << np.uint64(8 * k)
            out.append(out[-1] | higher if k else higher)
        return out

    @classmethod
    def places(cls, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - cls.BITS)

    def find(self, flat: np.ndarray) -> np.ndarray:
        """Of each byte of words in a row, whether a seam lies before it; a window over two words hides some."""
        crossed, most = np.zeros(len(flat) + self.LONGEST, bool), self.LONGEST
        for at in range(0, len(flat), self.STEP):
            here = flat[at:at + self.STEP + most - 1]
            here = np.concatenate([here, np.zeros(most - 1, np.uint8)])[:min(self.STEP, len(flat) - at) + most - 1]
            size = len(here) - most + 1
            keys = self.keys(here[k:k + size] for k in range(most))
            for n, table in self.tables.items():
                hit = table[self.places(keys[n])]
                for k in range(1, n):
                    crossed[at + k:at + k + size] |= hit
        return ~crossed[:len(flat)]


def literal(value, kind: str) -> Column:
    """A nested constant. Parsing a constant text is folded while planning, so this is one literal."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


class RankMap:
    """The literal rank map: two constant arrays, without collisions.

    The pairs of a left piece stand at its shift plus the right piece's id, the shifts being such that no two
    pairs meet. An entry holds its left piece over the rank, so what another piece left there, or nothing,
    gives a number above all ranks.
    """

    def __init__(self, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]):
        assert len(ranks) < MASK, "ids have 17 bits"
        width = max(ranks.values()) + 2  # the last id is the edge of a word, in no pair
        rows: dict[int, list[int]] = {}
        for a, b in pairs:
            rows.setdefault(a, []).append(b)
        span = 3 * len(pairs) + 1
        shifts, entries = np.zeros(width, np.int64), np.full(span + width, EMPTY)
        for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
            rights = np.array(rows[a])
            for first in range(span):  # windows of shifts, each somewhere else
                tried = (a * 40503 + first * 62143 + np.arange(512)) % span
                free = (entries[tried[:, None] + rights] == EMPTY).all(axis=1)
                if free.any():
                    break
            shifts[a] = shift = tried[free.argmax()]
            entries[rights + shift] = [a << 20 | pairs[a, b] for b in rows[a]]
        self.shifts, self.entries = literal(shifts.tolist(), "array<bigint>"), literal(entries.tolist(), "array<bigint>")
        self.edge = HIGH | width - 1
        byte = [ranks[bytes([b])] for b in range(256)]
        self.bytes = literal([min(pairs.get((a, b), NONE), NONE) << 45 | a for a in byte for b in [*byte, width - 1]], "array<bigint>")

    def pack(self, piece: Column, left: Column, right: Column) -> Column:
        """``piece`` (place and the id ``left``) under the rank of its pair with the id ``right``."""
        rank = self.entries[self.shifts[left] + right].bitwiseXOR(F.shiftleft(left, 20))
        return F.shiftleft(F.least(rank, F.lit(NONE)), 45).bitwiseOR(piece)


def fold(word: Column, ranks: RankMap) -> Column:
    """Ids of one word, an array of its bytes (0 to 255).

    The state is an array of the pieces between two edges: each one's id, above it the place of its first
    byte, above that the rank of the pair that it begins. So the least is the leftmost pair of lowest rank.
    """
    edge = F.lit(ranks.edge)
    pieces = F.transform(word, lambda b, i: ranks.bytes[b * F.lit(257) + F.coalesce(F.get(word, i + 1).cast("int"), F.lit(256))]
                         .bitwiseOR(F.shiftleft(i.cast("bigint"), 17)))

    def merge(s: Column, least: Column, at: Column) -> Column:  # at: the pair's place in the state, from 1
        new = F.shiftright(least, 45)  # a pair's rank is the id of what it merges to
        before = s[at - 2]
        merged = F.array(ranks.pack(before.bitwiseAND(PIECE), before.bitwiseAND(MASK), new),
                         ranks.pack(least.bitwiseAND(PIECE - MASK).bitwiseOR(new), new, s[at + 1].bitwiseAND(MASK)))
        return F.concat(F.slice(s, F.lit(1), at - 2), merged, F.slice(s, at + 2, F.lit(REST)))

    def step(s: Column, _: Column) -> Column:
        return let(F.array_min(s), lambda least: F.when(least >= F.lit(HIGH), s).otherwise(
            let(F.array_position(s, least).cast("int"), lambda at: merge(s, least, at))))

    return F.aggregate(F.slice(word, F.lit(2), F.lit(REST)), F.concat(F.array(edge), pieces, F.array(edge)), step,
                       lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda e: e.bitwiseAND(MASK).cast("int")))


BLOCK = "doc_ids array<bigint>, lengths array<int>, places array<int>, counts array<int>, parts array<int>, bytes array<array<smallint>>"


def blocks(docs: DataFrame, pattern: str, seams: Seams | None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents (doc_id, text) as blocks: doc_ids, how many words each document has, the words' numbers
    one document after the other, how many parts each distinct word has, the parts' numbers one word after
    the other, and the distinct parts as byte arrays. Without ``seams``, a word is one part.

    Where no match of the pattern runs from another character to white space, texts can be cut there before
    they are matched, and each distinct part is matched once. This is known of ``CUT_BY_SPACES`` only.
    """
    schema = T._parse_datatype_string(BLOCK)
    arrow, by_spaces = to_arrow_schema(schema), pattern in CUT_BY_SPACES
    shipped = bound_batches(docs.sparkSession).sparkContext.broadcast(seams)

    def run(batches):
        cut = regex.compile(pattern)

        class Numbers(dict):
            def __missing__(self, word):
                self[word] = n = len(self)
                return n

        class Chunks(dict):
            """Numbers of the words of a text's part between spaces, the space before it included, as bytes.
            None if words could reach beyond it: if it is empty or ends with white space."""

            def __init__(self, lead, numbers):
                self.lead, self.numbers = lead, numbers

            def __missing__(self, part):
                if part.isalpha():
                    got = array("i", (self.numbers[self.lead + part],)).tobytes()
                elif part and not part[-1].isspace():
                    got = array("i", map(self.numbers.__getitem__, cut.findall(self.lead + part))).tobytes()
                else:
                    got = None
                self[part] = got
                return got

        class Block:
            def __init__(self):
                self.numbers, self.doc_ids, self.places, self.size = Numbers(), [], [], 0
                self.first, self.later = Chunks("", self.numbers), Chunks(" ", self.numbers)

            def add(self, doc_id, text):
                parts = text.split(" ")
                found = [self.first[parts[0]], *map(self.later.__getitem__, parts[1:])] if by_spaces else [None]
                if None in found:
                    found = [array("i", map(self.numbers.__getitem__, cut.findall(text))).tobytes()]
                self.doc_ids.append(doc_id)
                self.places.append(np.frombuffer(b"".join(found), np.int32))
                self.size += len(text)

            def row(self):
                del self.first, self.later  # what they hold is large
                raw = [w.encode("utf-8", "surrogatepass") for w in self.numbers]
                self.numbers.clear()
                sizes = np.fromiter(map(len, raw), np.int64, len(raw))
                joined = b"".join(raw)
                del raw
                firsts = np.cumsum(sizes) - sizes
                starts = np.zeros(len(joined), bool) if shipped.value is None else shipped.value.find(np.frombuffer(joined, np.uint8))
                starts[firsts] = True
                cuts = np.append(np.flatnonzero(starts), len(joined))
                counts = np.diff(np.append(np.searchsorted(cuts, firsts), len(cuts) - 1))
                parts, at = Numbers(), cuts.tolist()
                numbers = np.fromiter((parts[joined[a:b]] for a, b in zip(at, at[1:])), np.int32, len(at) - 1)
                del at
                ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
                words = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(parts), np.uint8).astype("i2")))
                flat = np.concatenate(self.places)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                return pa.RecordBatch.from_arrays(
                    [pa.array([self.doc_ids], pa.list_(pa.int64())), pa.array([list(map(len, self.places))], pa.list_(pa.int32())),
                     one(pa.array(flat)), one(pa.array(counts, pa.int32())), one(pa.array(numbers)), one(words)], schema=arrow)

        block = Block()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):  # one text at a time is taken from Arrow
                block.add(doc_id.as_py(), text.as_py() or "")
                if block.size >= block_chars:
                    yield block.row()
                    block = Block()
        if block.doc_ids:
            yield block.row()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_blocks(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks with ``ids``, those of each part of their words."""
    pairs = pair_ranks(ranks)
    table, whole = RankMap(ranks, pairs), out_of_reach(ranks, pairs)
    taken = literal([list(w) for w in whole], "array<array<smallint>>")
    values = literal(list(whole.values()), "array<int>")

    def ids(word: Column) -> Column:
        if not whole:
            return fold(word, table)
        return let(F.array_position(taken, word).cast("int"),
                   lambda k: F.when(k > 0, F.array(values[k - 1])).otherwise(fold(word, table)))

    # a part may be a piece that only a whole word is taken for
    seams = None if whole else Seams(ranks)
    return blocks(docs, pattern, seams, block_chars).select("doc_ids", "lengths", "places", "counts", "parts", F.transform("bytes", ids).alias("ids"))


def spread(flat: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The values of the ``chosen`` lists one after the other, of lists of these sizes that lie in ``flat``."""
    size = sizes[chosen]
    shift = (np.cumsum(sizes) - sizes)[chosen] - (np.cumsum(size) - size)
    return flat[np.arange(size.sum()) + np.repeat(shift, size)]


def per_document(encoded: DataFrame, prepare, finish, added: str) -> DataFrame:
    """doc_id and, in the columns ``added``, what ``finish`` returns for the ids of each document, the numbers
    of its words in their block, and what ``prepare`` made of the ids of each word of the block."""
    schema = T._parse_datatype_string("doc_id bigint, " + added)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                take = lambda c: batch.column(c).slice(r, 1).flatten()
                folded, places, parts = take("ids"), take("places").to_numpy(), take("parts").to_numpy()
                lengths = folded.value_lengths().to_numpy()
                flat = spread(folded.flatten().to_numpy().astype("<u4"), lengths, parts)
                ends = np.append(0, np.cumsum(lengths[parts]))[np.cumsum(take("counts").to_numpy())]
                sizes = np.diff(ends, prepend=0)
                firsts = ends - sizes
                prepared, out, at = prepare(flat, ends), [], 0
                for n in take("lengths").to_pylist():
                    here = places[at:at + n]
                    size = sizes[here]
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    out.append(finish(flat[np.repeat(firsts[here], size) + step], here, prepared))
                    at += n
                columns = [take("doc_ids")] + [pa.array([o[k] for o in out], arrow.field(k + 1).type) for k in range(len(arrow) - 1)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return encoded.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids of every whole text of ``docs`` (doc_id, text; more columns are dropped).

    A null text is an empty one and has no ids; repeated rows are encoded alike; an empty table gives no
    rows. Special tokens have no meaning. A word of n bytes takes about n^2 steps at worst.
    """
    encoded = encode_blocks(docs, read_ranks(read_bytes(vocabulary)), pattern)
    return per_document(encoded, lambda ids, ends: None, lambda ids, here, _: (ids.astype("i4"),), "ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` (ids array<int>, any more columns) with ``decoded``, the binary pieces of the ids in a row."""
    ranks = read_ranks(read_bytes(vocabulary))
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    hexed = literal([p.hex() for p in pieces], "array<string>")
    return encoded.withColumn("decoded", F.unhex(F.array_join(F.transform("ids", lambda i: hexed[i]), "")))


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: documents encoded, decoded again, and both digested."""
    ranks = read_ranks(read_bytes(vocabulary))
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    pieces: dict[int, bytes] = {}

    def decoded(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The binary pieces of every word of a block."""
        if not pieces:
            pieces.update((i, p) for p, i in shipped.value.items())
        parts, start, words = list(map(pieces.__getitem__, ids.tolist())), 0, []
        for end in ends.tolist():
            words.append(b"".join(parts[start:end]))
            start = end
        return words

    def finish(ids: np.ndarray, here: np.ndarray, words: list[bytes]) -> tuple:
        text = b"".join(map(words.__getitem__, here.tolist()))
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()

    return per_document(encode_blocks(docs, ranks, pattern), decoded, finish, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
