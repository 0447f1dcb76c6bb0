"""Runs of words that repeat with a period, by sparse diagonal dynamic programming (operator 13).

A word ``lag`` words after an equal one continues the diagonal ``lag``; the length of the match on it grows
with every such word and ends at the first that differs. A diagonal that ends with enough matches is a run
of period ``lag``, emitted at once.

Only what can become a run is followed, and nothing that can is left out. A run of period q and length
max(12, 2q) or more has at least max(12 - q, q) matches, so

* lags come in bands, 1 to 7, 8 to 15, 16 to 31 and so on, and in the band from w on only equal windows of
  w words (six in the first) start or continue a diagonal; most texts have none;
* windows inside a known run of a period q <= w / 2 are not compared with windows of the same run: all their
  lags are multiples of q, the stretch of each is that very run, and its smallest period is known.

So a text of one word a million times over costs a few steps a word, not a million.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import let
from siftwell.llm.common import per_batch, texts, whole

#: The least length of a run in words, and in periods.
LEAST, PERIODS = 12, 2
#: Matches that a run of any period has at least, and the lags of the first band.
WINDOW, FIRST_BAND = LEAST // 2, 8
#: Words that are looked at together; longer texts are looked at alone.
WORDS = 200_000


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows of ``keys``, small numbers from zero."""
    out = np.unique(keys[0], return_inverse=True)[1]
    for key in keys[1:]:
        out = np.unique(out * (int(key.max(initial=0)) + 1) + key, return_inverse=True)[1]
    return out


def repeated(places: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those whose name occurs twice or more."""
    keep = np.bincount(names)[names] > 1 if len(names) else np.zeros(0, bool)
    return places[keep], names[keep]


def windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last places and names of the windows of six words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):  # may mix up different windows, never parts equal ones
        mixed = (mixed ^ words[k:k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    same = mixed[order[1:]] == mixed[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    first = np.flatnonzero(twice)
    return repeated(first + WINDOW - 1, ranks(*(words[first + k] for k in range(WINDOW))))


def wider(places: np.ndarray, names: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that are two of the given ones, the first ``step`` words before the second."""
    if not len(places):
        return places, names
    at = np.searchsorted(places, places - step)
    there = places[at] == places - step
    return repeated(places[there], ranks(names[at[there]], names[there]))


def earlier(places: np.ndarray, names: np.ndarray, width: int, low: int, high: int, runs: list) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags, low <= lag < high, of windows and their earlier occurrences, in the order of places.

    Windows of one run of a period up to half their width are not compared with each other."""
    label = np.full(len(places), -1)
    for number, (start, end, period) in enumerate(runs):
        if 2 * period <= width <= end - start:
            label[np.searchsorted(places, start + width - 1):np.searchsorted(places, end)] = number
    order = np.lexsort((places, names))
    place, name, own = places[order], names[order], label[order]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (own[1:] != own[:-1]) | (own[1:] < 0)
    before = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0)) - 1
    at, ends, lags = np.arange(len(place)), [], []
    while len(at):
        ok = before >= 0
        at, before = at[ok], before[ok]
        lag = place[at] - place[before]
        ok = (name[at] == name[before]) & (lag < high)
        at, before, lag = at[ok], before[ok] - 1, lag[ok]
        ends.append(place[at[lag >= low]])
        lags.append(lag[lag >= low])
    ends, lags = np.concatenate(ends or [places[:0]]), np.concatenate(lags or [places[:0]])
    order = np.argsort(ends, kind="stable")
    return ends[order], lags[order]


def follow(ends: np.ndarray, lags: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(start, end, lag) of the diagonals that ended with enough matches: the online pass over the words.

    ``active`` holds each lag's first and last matching window; a diagonal is over when its lag comes up
    again after a gap, or at the end of the words."""
    active: dict[int, list[int]] = {}
    found = []

    def emit(lag: int, first: int, last: int) -> None:
        matches = last - first + width
        if matches >= (PERIODS - 1) * lag and matches + lag >= LEAST:
            found.append((first - width + 1 - lag, last + 1, lag))

    for end, lag in zip(ends.tolist(), lags.tolist()):
        diagonal = active.get(lag)
        if diagonal is None:
            active[lag] = [end, end]
        elif diagonal[1] == end - 1:
            diagonal[1] = end
        else:
            emit(lag, *diagonal)
            active[lag] = [end, end]
    for lag, diagonal in active.items():
        emit(lag, *diagonal)
    return found


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All (start, end, smallest period) of a sequence of numbers, sorted; a number that occurs once (put
    between texts) parts runs."""
    places, names = windows(words)
    smallest: dict[tuple[int, int], int] = {}
    width, low = WINDOW, 1
    while len(places):
        known = [(start, end, period) for (start, end), period in smallest.items()]
        high = FIRST_BAND if low == 1 else 2 * low
        # a stretch that has two of the lags found has the smaller as its period
        for start, end, lag in follow(*earlier(places, names, width, low, high, known), width):
            smallest[start, end] = min(lag, smallest.get((start, end), lag))
        places, names = wider(places, names, high - width)
        width = low = high
    return sorted((start, end, period) for (start, end), period in smallest.items())


def in_texts(split: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, as (start, length, period)."""
    numbers, starts, numbered = count(), [], []
    for words in split:
        starts.append(len(numbered))
        name = defaultdict(numbers.__next__)  # words of different texts differ
        numbered.extend(map(name.__getitem__, words))
        numbered.append(next(numbers))
    out: list[list[tuple[int, int, int]]] = [[] for _ in split]
    found = runs_of(np.array(numbered, np.int64))
    owner = np.searchsorted(starts, [start for start, _, _ in found], "right") - 1
    for (start, end, period), text in zip(found, owner.tolist()):
        out[text].append((start - starts[text], end - start, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that any run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` of ``docs`` (all columns by default, which then may not be called like the new ones) with
    n_words, runs (start, length, period; by start, then period) and collapsed, the kept words joined by one
    blank; one row for each row.

    A run is a stretch of words with smallest period q, of max(12, 2q) words or more, that neither
    neighbour extends. Null and blank texts have no words, no runs and an empty collapsed text; repeated
    rows get the same runs; an empty table gives no rows. Texts are taken whole, at any length.
    """
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            split, runs, size, todo = [], [], 0, []
            for t in texts(batch, text):
                words = t.encode("utf-8", "surrogatepass").split()
                if todo and size + len(words) > WORDS:
                    done(todo, runs, split)
                    size, todo = 0, []
                todo.append(words)
                size += len(words)
            done(todo, runs, split)
            return {"n_words": [n for n, _ in split], "runs": runs, "collapsed": [c for _, c in split]}

        def done(todo: list, runs: list, split: list) -> None:
            for words, found in zip(todo, in_texts(todo)):
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                split.append((len(words), b" ".join(collapse(words, found)).decode("utf-8", "surrogatepass")))

        return work

    return per_batch(docs, make, "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
                     keep=keep, name=text)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs`` (doc_id, text), where every tenth document by the crc32 of its id ends in
    a passage over and over.

    With h = crc32(doc_id in decimal) and g = floor(h / 10), a text of n words with h % 10 = 0 gets word
    a + (i - a) % p in place of each word i >= a = g % n, where p = 1 + floor((n - a) / (3 + g % 8)). Its
    words are then parted by one blank. A null doc_id has no h: such texts, and those without words, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def tail(words):
        n = F.size(words).cast("bigint")
        return F.when(n == 0, F.lit("")).otherwise(let(F.struct(words.alias("w"), (g % n).alias("a"), n.alias("n")), rewritten))

    def rewritten(s):
        period = 1 + F.floor((s["n"] - s["a"]) / (3 + g % 8)).cast("bigint")
        return let(F.struct(s["w"].alias("w"), s["a"].alias("a"), period.alias("p")), lambda t: F.array_join(F.transform(
            t["w"], lambda x, i: F.when(i < t["a"], x).otherwise(F.get(t["w"], (t["a"] + (i - t["a"]) % t["p"]).cast("int")))), " "))

    words = F.filter(F.split(whole(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, tail)).otherwise(F.col("text")).alias("text"))
