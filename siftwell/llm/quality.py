"""Quality rules with n-gram perplexity bands (operator 8).

One modified Kneser-Ney model a language, over n-grams of five characters as they are. Spark counts them
over the whole texts of all documents; the tables grow with the corpus and are never gathered in one place:

1. A task counts the n-grams of its documents, so each leaves it once, with its task's number.
2. Counts become probabilities by grouping and joins, order by order (``Model``).
3. Every n-gram's probability goes to the tasks that met it and is written as one sorted array of n-gram
   hashes a task and language, the only part of the model that scoring its documents needs.
4. The tasks run over the same documents again and look their n-grams up by binary search.

So what moves is one row for each n-gram and task, a small part of the texts, and a task holds what its own
documents need.

The log perplexity of a text is taken a character and a word: easy marks between the words lower the first
and raise the second. A mean over n words deviates by 1 / sqrt(n) of what one word does, so a language's
bands lie around its median at so many robust deviations over sqrt(n). A document outside the lower or upper
band of either is rejected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import per_batch, released, stored, texts, with_row
from siftwell.session import scratch_path


ORDER = 5
SYMBOLS = "#*$%&|<>"
#: Half-widths of a band below and above the median, in robust deviations of a text of so many words, and the
#: least width as a share of the median.
BELOW, ABOVE, LEAST = 2.75, 2.75, 0.01
MEASURES = ["log_perplexity", "word_log_perplexity"]
FEWEST_WORDS = 50
SPACES = b" \t\n\r\x0b\x0c"
#: Characters that are looked at together, different n-grams a task holds before it hands them on, and those
#: that wait to be merged with them.
CHUNK, HELD, WAITING = 1 << 20, 1 << 20, 1 << 18
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def hashes(padded: np.ndarray) -> np.ndarray:
    """A hash of each run of ``ORDER`` characters, as signed numbers."""
    n = max(0, len(padded) - ORDER + 1)
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = (out ^ padded[k:k + n]) * FACTOR
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def chunks(rows: list[str]):
    """(characters, starts of their n-grams, row of each) of pieces of the texts, an n-gram ending at each
    character; line ends stand before a text. Long texts come in several pieces."""
    pad = np.full(ORDER - 1, 10, np.uint32)
    parts, owners, size = [], [], 0
    for row, text in enumerate(rows):
        found = np.concatenate([pad, points(text)])
        for at in range(0, len(found) - ORDER + 1, CHUNK):
            part = found[at:at + CHUNK + ORDER - 1]
            if size and size + len(part) > 2 * CHUNK:
                yield joined(parts, owners)
                parts, owners, size = [], [], 0
            parts.append(part)
            owners.append(row)
            size += len(part)
    if parts:
        yield joined(parts, owners)


def joined(parts: list[np.ndarray], owners: list[int]):
    lengths = np.array([len(p) for p in parts])
    n = lengths - ORDER + 1
    first = np.cumsum(lengths) - lengths
    starts = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    return np.concatenate(parts), starts, np.repeat(owners, n)


def by_language(batch: pa.RecordBatch) -> dict[str | None, list[int]]:
    out: dict[str | None, list[int]] = {}
    for i, lang in enumerate(batch.column("lang").to_pylist()):
        out.setdefault(lang, []).append(i)
    return out


def merged(parts: list[tuple]) -> tuple:
    """One (hashes, n-grams, counts) of several, each hash once; all are sorted by hash."""
    if len(parts) == 1:
        return parts[0]
    h = np.concatenate([p[0] for p in parts])
    order = np.argsort(h, kind="stable")  # sorted runs, which are only merged
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.add.reduceat(np.concatenate([p[2] for p in parts])[order], first)
    return h[first], np.concatenate([p[1] for p in parts])[order[first]], n


def counted(batches):
    """(language, n-grams, counts) of the texts of record batches. New n-grams wait until there are
    ``WAITING`` and are merged then, so small batches cost no more than large ones; an n-gram comes again
    when there are more than ``HELD`` different ones."""
    held: dict[str | None, list[tuple]] = {}
    waiting = 0
    for batch in batches:
        rows = texts(batch)
        for lang, members in by_language(batch).items():
            for chars, starts, _ in chunks([rows[i] for i in members]):
                h, first, n = np.unique(hashes(chars)[starts], return_index=True, return_counts=True)
                held.setdefault(lang, []).append((h, chars[starts[first][:, None] + np.arange(ORDER)], n))
                waiting += len(h)
                if waiting > WAITING:
                    for known in held:
                        held[known] = [merged(held[known])]
                    waiting = 0
                    if sum(len(x[0][0]) for x in held.values()) > HELD:
                        for known in list(held):
                            yield known, *held.pop(known)[0][1:]
    for known in list(held):
        yield known, *merged(held.pop(known))[1:]


def task_counts(docs: DataFrame) -> DataFrame:
    """task, lang, gram, n: how often each n-gram stands in the documents of a task."""
    schema = "task int, lang string, gram string, n bigint"

    def run(batches):
        task = TaskContext.get().partitionId()
        for lang, g, n in counted(batches):
            for at in range(0, len(n), 25_000):
                part = slice(at, at + 25_000)
                grams = [x.tobytes().decode("utf-32-le", "surrogatepass") for x in g[part]]
                rows = len(grams)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, task, "i4")), pa.array([lang] * rows, pa.string()),
                     pa.array(grams, pa.string()), pa.array(n[part])], names=["task", "lang", "gram", "n"])

    # all columns go along, as what a plan deals to a task may depend on its columns
    return docs.mapInArrow(released(run), schema)


def named(lang: Column) -> Column:
    """A language as a key that is never null."""
    return F.coalesce(F.concat(F.lit("l"), lang), F.lit("-"))


class Model:
    """Stored tables of one modified Kneser-Ney model a language, from stored counts (lang, gram, n) of its n-grams.

    The highest order uses counts, lower ones the number of different characters seen before
    (continuation counts); each order is interpolated with the one below, the lowest with equal shares.
    """

    def __init__(self, counts: DataFrame, order: int = ORDER):
        self.order = order
        level = counts.select("lang", "gram", "n")
        levels = {order: level}
        for k in range(order - 1, 0, -1):
            shorter = F.substring("gram", 2, k).alias("gram")
            levels[k] = level = stored(level.groupBy("lang", shorter).agg(F.count("*").alias("n")), "grams")
        # order 0: each character of the language alike
        self.shares = {0: stored(levels[1].groupBy("lang").agg((1 / F.count("*")).alias("p")), "shares")}
        self.left: dict[int, DataFrame] = {}
        for k in range(1, order + 1):
            self.left[k], self.shares[k] = self.shared(levels[k], self.shares[k - 1], k)

    @staticmethod
    def discounts(level: DataFrame) -> DataFrame:
        """lang, d: what is taken off counts of 1, 2 and 3 or more, from how many n-grams have 1 to 4."""
        t = [F.greatest(F.lit(1), F.count_if(F.col("n") == k)).cast("double") for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        d = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]]
        clipped = [F.least(F.lit(most), F.greatest(F.lit(0.05), x)) for x, most in zip(d, (0.95, 1.95, 2.95))]
        # stored, as Spark then knows that it is one row a language and moves no n-gram for it
        return stored(level.groupBy("lang").agg(F.array(*clipped).alias("d")), "discounts")

    def shared(self, level: DataFrame, below: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """What is left for lower orders after each context (lang, context, left), and p of each n-gram."""
        off = F.get("d", F.least("n", F.lit(3)).cast("int") - 1)
        rows = level.join(self.discounts(level), "lang").select(
            "lang", "gram", F.substring("gram", 1, k - 1).alias("context"), "n", off.alias("off"))
        totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("left"))
        on = ["lang"] if k == 1 else ["lang", "shorter"]
        below = below if k == 1 else below.withColumnRenamed("gram", "shorter")
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("left") * F.col("p")
        out = rows.join(totals, ["lang", "context"]).withColumn("shorter", F.substring("gram", 2, k - 1)).join(below, on) \
            .select("lang", "gram", p.alias("p"))
        return totals.select("lang", "context", "left"), stored(out, "shares")

    def of(self, grams: DataFrame) -> DataFrame:
        """``grams`` (lang, gram, more) with p, also of n-grams and languages not counted: what an unseen
        n-gram's context leaves, times the shorter n-gram's p. A language not counted has no p."""
        out = grams.join(self.shares[0].withColumnRenamed("p", "_p"), "lang", "left")
        for k in range(1, self.order + 1):
            end, context = F.substring("gram", self.order - k + 1, k), F.substring("gram", self.order - k + 1, k - 1)
            out = out.withColumns({"_g": end, "_c": context}) \
                .join(self.shares[k].select("lang", F.col("gram").alias("_g"), "p"), ["lang", "_g"], "left") \
                .join(self.left[k].select("lang", F.col("context").alias("_c"), "left"), ["lang", "_c"], "left") \
                .withColumn("_p", F.coalesce("p", F.coalesce("left", F.lit(1.0)) * F.col("_p"))).drop("p", "left", "_g", "_c")
        return out.withColumnRenamed("_p", "p")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1] if len(number) > 1_000_000 else ids[:-1] * len(number) + ids[1:]
    window = pair[:-1] * len(number) + ids[2:]
    _, inverse, n = np.unique(window, return_inverse=True, return_counts=True)
    twice = n[inverse] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k:len(words) - 2 + k] |= twice
    return int(inside.sum())


def base(text: str) -> dict[str, int]:
    """The counts of the fixed rules."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blank = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return {"n_words": len(words), "word_chars": len(text) - blank, "n_symbols": symbols,
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_words(words)}


def hashed(batches):
    """Batches of task, lang, gram, log with the n-grams' hashes in place of the n-grams."""
    for batch in batches:
        chars = points("".join(batch.column("gram").to_pylist())).reshape(-1, ORDER)
        out = np.zeros(len(chars), np.uint64)
        for k in range(ORDER):
            out = (out ^ chars[:, k]) * FACTOR
            out ^= out >> np.uint64(29)
        yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("lang"), pa.array(out.view(np.int64)), batch.column("log")],
                                         names=["task", "lang", "hash", "log"])


def written_arrays(counts: DataFrame, model: Model) -> str:
    """Folder with the Parquet files of each task: its n-grams' languages, hashes and log probabilities, sorted."""
    spark, path = counts.sparkSession, scratch_path(counts.sparkSession, "arrays")
    known = counts.select("lang", "gram", "tasks").join(model.shares[model.order], ["lang", "gram"])
    rows = known.select(F.explode("tasks").alias("task"), "lang", "gram", F.log("p").cast("float").alias("log"))
    rows.repartition("task").mapInArrow(released(hashed), "task int, lang string, hash bigint, log float") \
        .sortWithinPartitions("task", "lang", "hash").write.partitionBy("task").parquet(path)
    return path


class Scorer:
    """The part of the model that a task's documents need, read from the shared folder."""

    def __init__(self, folder: str, task: int):
        self.arrays = {}
        local = folder.removeprefix("file:") if folder.startswith("file:/") else folder
        files, root = pyarrow.fs.FileSystem.from_uri(local) if "://" in local else (pyarrow.fs.LocalFileSystem(), local)
        where = pyarrow.fs.FileSelector(f"{root}/task={task}", allow_not_found=True)
        names = [f.path for f in files.get_file_info(where) if f.path.endswith(".parquet")]
        if names:
            table = pa.concat_tables(pq.read_table(files.open_input_file(n)) for n in sorted(names))
            lang = table.column("lang").combine_chunks().dictionary_encode()
            code, h, logs = lang.indices.to_numpy(), table.column("hash").to_numpy(), table.column("log").to_numpy()
            for i, name in enumerate(lang.dictionary.to_pylist()):
                order = np.argsort(h[code == i], kind="stable")
                self.arrays[name] = h[code == i][order], logs[code == i][order]

    def logs(self, lang: str | None, h: np.ndarray) -> np.ndarray:
        keys, logs = self.arrays.get("-" if lang is None else "l" + lang, (np.zeros(0, np.int64), np.zeros(0, "f4")))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1) if len(keys) else np.zeros(0, np.int64)
        if len(at) < len(h) or (keys[at] != h).any():
            raise RuntimeError("a task met other documents than when they were counted; store the documents first")
        return logs[at]

    def totals(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, minus its log probability and its characters."""
        rows = texts(batch)
        total, n = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        for lang, members in by_language(batch).items():
            members = np.array(members)
            for chars, starts, owner in chunks([rows[i] for i in members]):
                logs = self.logs(lang, hashes(chars)[starts])
                total[members] += np.bincount(owner, logs, len(members))
                n[members] += np.bincount(owner, minlength=len(members))
        return -total, n


def measure(docs: DataFrame, folder: str, keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` with the base counts, base_failed, log_perplexity (null without a character)
    and word_log_perplexity (null without a word).

    ``docs`` has to be dealt to tasks as it was when counted: a table as it lies, or a stored one."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def make():
        scorer = Scorer(folder, TaskContext.get().partitionId())

        def work(batch):
            rows = [base(t) for t in texts(batch)]
            total, n = scorer.totals(batch)
            return {c: [r[c] for r in rows] for c in names} | {
                "log_perplexity": [float(t / k) if k else None for t, k in zip(total, n)],
                "word_log_perplexity": [float(t / r["n_words"]) if r["n_words"] else None for t, r in zip(total, rows)]}

        return work

    measured = per_batch(docs, make, ", ".join(f"{c} bigint" for c in names) + "".join(f", {m} double" for m in MEASURES),
                         keep=list(dict.fromkeys([*keep, "lang"])), prune=False, tidy=True)
    return measured.withColumn("base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def fit(docs: DataFrame) -> tuple[str, Model]:
    """The folder that ``measure`` reads, and the model of all ``docs``.

    An n-gram's row lists the tasks that met it: as many at most as there are tasks, whatever their documents hold."""
    met = task_counts(docs).withColumn("lang", named(F.col("lang"))).repartition("lang", "gram")
    counts = stored(met.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.collect_set("task").alias("tasks")), "counts")
    model = Model(counts)
    return written_arrays(counts, model), model


def bands(measured: DataFrame) -> DataFrame:
    """_lang, and of each measure its _median_ and _spread_ (a robust deviation of one word) from all of a
    language's documents that pass the fixed rules. One row for each language; null is one of its own."""
    usable = measured.where(~F.col("base_failed")).select(named(F.col("lang")).alias("_lang"), "n_words", *MEASURES)
    # stored: one row a language, which Spark then sends to the documents instead of dealing them by language
    middle = stored(usable.groupBy("_lang").agg(*(F.percentile_approx(m, 0.5, 10_000).alias(f"_median_{m}") for m in MEASURES)), "medians")
    off = usable.join(middle, "_lang")
    spread = off.groupBy("_lang").agg(*(F.percentile_approx(
        F.abs(F.col(m) - F.col(f"_median_{m}")) * F.sqrt("n_words"), 0.5, 10_000).alias(f"_spread_{m}") for m in MEASURES))
    return stored(middle.join(spread, "_lang").select("_lang", *(f"_median_{m}" for m in MEASURES), *(
        (F.col(f"_spread_{m}") * 1.4826).alias(f"_spread_{m}") for m in MEASURES)), "bands")


def verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with kept: passes the fixed rules and lies inside its language's bands."""
    def inside(m: str) -> Column:
        off, middle = F.col(m) - F.col(f"_median_{m}"), F.col(f"_median_{m}")
        unit = F.col(f"_spread_{m}") / F.sqrt(F.greatest("n_words", F.lit(1)))
        return off.between(-F.greatest(BELOW * unit, LEAST * middle), F.greatest(ABOVE * unit, LEAST * middle))

    joined = measured.withColumn("_lang", named(F.col("lang"))).join(limits, "_lang", "left")
    good = reduce(lambda x, y: x & y, map(inside, MEASURES))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False))) \
        .drop("_lang", *(f"_{what}_{m}" for what in ("median", "spread") for m in MEASURES))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base counts, base_failed, log_perplexity, kept of ``docs`` (doc_id, text, lang; more
    columns are dropped), one row for each row.

    A null text is an empty one; texts without a word fail the fixed rules; repeated rows get the same
    verdict; null is a language of its own; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", "lang")
    measured = stored(measure(docs, fit(docs)[0], ["doc_id"]), "measured")
    return verdicts(measured, bands(measured))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; nulls, repeats and empty tables as in ``judge``.

    Texts are measured twice, for the bands and for the verdict, rather than moved."""
    rows = with_row(docs, "text", "lang")
    folder = fit(rows)[0]
    limits = bands(stored(measure(rows, folder, []), "measured"))
    return verdicts(measure(rows, folder, ["_row"]), limits).where("kept").select("_row.*")
