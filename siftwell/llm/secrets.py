"""Secrets in texts, told from copied examples by who owns them (operator 10); DataFrame functions only.

Three fixed kinds are found by pattern. The method adds spans: every long mixed token is a candidate; a
candidate's hash is counted over the corpus by distinct owners. One that a single owner has, in however
many documents, looks live and is added as kind ``live``; those of more owners are copied examples, unless
the caller allows several owners and the repositories are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import stored, whole, with_row

#: Kinds in their order, pattern, and the least length of group 2 or of the match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "live"]

#: Candidates: tokens of 20 characters or more; the rules of ``mixed`` apply to them.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])"
MASK = "[SECRET]"


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, match), in code points, end exclusive.

    Built from the pieces between the matches and the matches themselves; texts without a match are not
    taken apart.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("match"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda state: state["out"])
    return F.when(text.rlike(pattern), placed).otherwise(none)


def mixed(token: Column) -> Column:
    """Looks generated: letters and digits both, ten or more different characters, digits in three places
    or more. Words, numbers, rules and paths of plain words fail."""
    distinct = F.size(F.array_distinct(F.split(token, "")))
    return token.rlike("[A-Za-z]") & token.rlike(r"[0-9][^0-9]+[0-9][^0-9]+[0-9]") & (distinct >= 10)


def kind_of(items: Column, kind: str) -> Column:
    return F.transform(items, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with _base (start, kind, end) sorted, _found (candidate hash, start, end) and _key, a digest
    of the text: what a text holds depends on the text alone. A null text is an empty one."""
    text = whole(F.col("text"))
    long_enough = F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8)
    base = F.array_sort(F.concat(kind_of(long_enough, "assign"), kind_of(spans(text, ACCESS), "access"),
                                 kind_of(spans(text, HEX), "hex")))
    candidates = F.transform(F.filter(spans(text, CANDIDATE), lambda s: mixed(s["match"])), lambda s: F.struct(
        F.sha2(F.lower(s["match"]), 256).alias("hash"), s["start"].alias("start"), s["end"].alias("end")))
    return docs.withColumn("_base", base).withColumn("_found", candidates).withColumn("_key", F.sha2(text, 256))


def ownership(scanned: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """hash, repositories, owners: in how many distinct ones a candidate occurs (null is one of its own).

    Exact copies of a text count as one repository, the smallest of theirs, but for each owner that has one.
    Distinct tuples first, then counts that combine before they move, so a candidate that every document
    copies loads no single task.
    """
    found = scanned.select(F.explode("_found.hash").alias("hash"), "_key", repository.cast("string").alias("repository"),
                           owner.cast("string").alias("owner"))
    places = found.groupBy("hash", "_key").agg(F.min("repository").alias("repository")).select("hash", "repository").distinct() \
        .groupBy("hash").agg(F.count("*").alias("repositories"))
    return found.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners")).join(places, "hash")


def live(scanned: DataFrame, repository: Column, owner: Column, most_repositories: int, most_owners: int) -> DataFrame:
    """_key and _live, the (start, kind, end) of candidates that look live, for texts that hold any.

    One owner is enough; of two to ``most_owners`` owners, only those in few repositories."""
    few = F.col("repositories") <= most_repositories
    specific = ownership(scanned, repository, owner).where(
        (F.col("owners") <= most_owners) & ((F.col("owners") == 1) | few)).select("hash")
    places = scanned.where(F.size("_found") > 0).select("_key", F.explode("_found").alias("c")) \
        .select("_key", "c.hash", "c.start", "c.end").distinct()
    item = F.struct(F.col("start"), F.lit(KINDS.index("live")).alias("kind"), F.col("end"))
    return places.join(specific, "hash").groupBy("_key").agg(F.array_sort(F.collect_list(item)).alias("_live"))


def written(items: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(items, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find(docs: DataFrame, repository: Column, owner: Column, most_repositories: int = 2, most_owners: int = 1) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of ``docs`` (doc_id, text, what ``repository`` and
    ``owner`` need; more columns are dropped).

    One row for each row. Null and empty texts have no spans; exact copies count as one repository. The
    text is read once; what is found in it is stored without it.
    """
    rows = docs.select("doc_id", "text", repository.alias("_repository"), owner.alias("_owner"))
    found = stored(scan(rows).drop("text"), "secrets")
    added = stored(live(found, F.col("_repository"), F.col("_owner"), most_repositories, most_owners), "live")
    every = F.array_sort(F.concat("_base", F.coalesce("_live", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")

    return found.join(added, "_key", "left").select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(every).alias("spans"))


def masked(text: Column, items: Column) -> Column:
    """``text`` with every span (sorted by start; spans may overlap) replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], F.array(
            F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(MASK)))
        return F.when(s["end"] <= state["at"], state).otherwise(F.struct(
            s["end"].alias("at"), F.when(s["start"] < state["at"], state["out"]).otherwise(fresh).alias("out")))

    def finish(state: Column) -> Column:
        return F.array_join(F.concat(state["out"], F.array(F.substring(text, state["at"] + 1, F.length(text)))), "")

    return F.when(F.size(items) > 0, F.aggregate(items, start, step, finish)).otherwise(text)


def mask(docs: DataFrame, repository: Column, owner: Column, most_repositories: int = 2, most_owners: int = 1) -> DataFrame:
    """``docs`` with all columns and rows, found secrets replaced in the texts; other texts stay as they are."""
    scanned = scan(with_row(docs, "text", repository.alias("_repository"), owner.alias("_owner")))
    found = stored(scanned.select("_repository", "_owner", "_found", "_key"), "secrets")
    added = stored(live(found, F.col("_repository"), F.col("_owner"), most_repositories, most_owners), "live")
    every = F.array_sort(F.concat("_base", F.coalesce("_live", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return scanned.join(added, "_key", "left").select(
        F.col("_row").withField("text", masked(F.col("text"), every)).alias("_row")).select("_row.*")
