"""Names of a long list found in texts, without one test for each name in the plan.

A list under ``MOST_BYTES`` is sent to all tasks, where one Aho-Corasick automaton finds all names of a text
in a single pass; only the text column goes through Arrow. A longer list stays distributed: each name is
keyed by its rarest gram of three characters, texts are joined on the grams they hold, and what meets is
checked. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import SPACE, col, trim_ws

#: Text of a list that is sent to all tasks, at most.
MOST_BYTES = 32 << 20
GRAM = 3


def plain_words(text) -> Column:
    """Lower case, with one blank before, between and after the words."""
    between = f"(?:{SPACE}|[,;:()!?]|[.](?=$|{SPACE}))+"
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), between, " "), F.lit(" "))


def listed(names: DataFrame, name: str, whole_words: bool) -> DataFrame:
    """Distinct _name as it is given and _look, what is looked for; blank ones and nulls are none."""
    low = trim_ws(F.lower(name))
    return names.select(F.col(name).alias("_name"), F.concat(F.lit(" "), low, F.lit(" ")).alias("_look") if whole_words else low.alias("_look")) \
        .where(F.length(F.trim("_look")) > 0).distinct()


def by_automaton(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Names found in a column, sorted; ``pairs`` of (name, what is looked for)."""
    looks: dict[str, list[str]] = {}
    for name, look in pairs:
        looks.setdefault(look, []).append(name)

    @F.pandas_udf("array<string>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for look, own in looks.items():
            tree.add_word(look, own)
        tree.make_automaton() if looks else None
        for part in parts:
            yield pd.Series([sorted({n for _, own in tree.iter(t) for n in own}) if looks and t else [] for t in part])

    return find(text)


def grams(text: str, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)),
                                        lambda i: F.substring(F.col(text), i, F.lit(size))))


def by_grams(texts: DataFrame, names: DataFrame) -> DataFrame:
    """_text and _found of distinct _text, for those with any name."""
    size = names.agg(F.min(F.length("_look"))).head()[0]
    size = min(GRAM, size or GRAM)
    pieces = names.select("_name", "_look", F.explode(grams("_look", size)).alias("gram"))
    often = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    keyed = pieces.join(often, "gram").groupBy("_name", "_look").agg(F.min(F.struct("n", "gram")).alias("k")) \
        .select("_name", "_look", F.col("k.gram").alias("gram"))
    held = texts.where(F.length("_text") >= size).select("_text", F.explode(grams("_text", size)).alias("gram"))
    return held.join(keyed, "gram").where(F.contains("_text", "_look")) \
        .groupBy("_text").agg(F.array_sort(F.collect_set("_name")).alias("_found"))


def find_names(df: DataFrame, text: str, names: DataFrame, name: str = "name", out: str = "found",
               whole_words: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with ``out``, the sorted names of ``names`` that its ``text`` holds: as whole words, or anywhere.

    Case does not count; names keep their spelling. A null text holds none. Above ``most_bytes`` of names,
    texts are joined by their value, which suits short ones (titles, companies).
    """
    found = listed(names, name, whole_words)
    size = found.agg(F.coalesce(F.sum(F.octet_length("_name") + F.octet_length("_look")), F.lit(0))).head()[0]
    prepared = df.withColumn("_text", plain_words(text) if whole_words else F.lower(F.coalesce(col(text), F.lit(""))))
    if size <= most_bytes:
        pairs = [(r["_name"], r["_look"]) for r in found.collect()]
        return prepared.withColumn(out, by_automaton(F.col("_text"), pairs)).drop("_text")
    hits = by_grams(prepared.select("_text").distinct(), found)
    return prepared.join(hits, "_text", "left").withColumn(out, F.coalesce("_found", F.array().cast("array<string>"))) \
        .drop("_text", "_found")


def block_listed(df: DataFrame, names: DataFrame, name: str = "name", company: str = "company_name",
                 most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with ``blocked``: its company's name contains one of a long list; a blank name never does."""
    return find_names(df, company, names, name, "_blocking", False, most_bytes) \
        .withColumn("blocked", F.size("_blocking") > 0).drop("_blocking")
