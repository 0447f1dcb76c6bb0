"""Personal data, and the words that give it away, by corpus co-occurrence (operator 11).

Four fixed kinds are found by pattern; their values are the protected entities. The method adds spans: a
term t reveals an entity e by PMI(e; t) = log2(p(e, t) / (p(e) p(t))) bits of the -log2 p(e) that knowing e
is worth, with p(t) and p(e) the shares of documents that hold them and p(e, t) that of documents in which
t stands within ``CONTEXT`` words of e. Terms that reveal enough are sanitised in the documents that hold
both: generalised to their class where the class itself reveals nothing, removed otherwise.

PMI(e; t) is at most -log2 p(t), so a term in more than 2^-BITS of the documents reveals too little about
anything. There are at most 2^BITS times as many such terms as a document has different words on average,
however large the corpus is; that bounds what is broadcast.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import per_batch, stored, texts, with_row

#: Kinds in their order. The last two are the method's.
KINDS = ["email", "ip", "card", "phone", "general", "removed"]
BASE = 4
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: All numeric kinds lie inside such stretches.
NUMERIC = re.compile(r"[+0-9][\x20().0-9+-]{5,}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Words on either side of an entity that count as near it.
CONTEXT = 10
#: Thresholds: bits revealed, their share of the entity's, and different texts that show the two together.
BITS, SHARE, SUPPORT = 6.0, 0.8, 3
#: Different terms a task counts before it hands them on.
HELD = 300_000
CLASSES = ["number", "code", "name", "word"]
EDGES = string.punctuation + "«»„“”‘’–—…¿¡\x00"
WORD = re.compile(r"\S+")


def digits(match: str) -> str:
    return "".join(c for c in match if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, entity) by kind, then start. Time is linear in the text."""
    out, seen = [], 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        # no character of a local part is an @, so one starts where the characters before the @ allow it
        start = seen + len(text[seen:m.start()].rstrip(LOCAL))
        seen = m.start()
        if start < m.start():
            out.append((0, start, m.end(), text[start:m.end()].lower()))
            seen = m.end()
    rest: list[list] = [[], [], []]
    for region in NUMERIC.finditer(text):
        part, at = region.group(), region.start()
        if part.count(".") > 2:
            rest[0] += [(1, at + m.start(), at + m.end(), m.group()) for m in IP.finditer(part)
                        if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m.group().split("."))]
        for m in CARD.finditer(part):
            number = digits(m.group())
            if 13 <= len(number) <= 19 and luhn(number):
                rest[1].append((2, at + m.start(), at + m.end(), number))
        for m in PHONE.finditer(part) if "+" in part else ():
            number = digits(m.group())
            if 9 <= len(number) <= 15:
                rest[2].append((3, at + m.start(), at + m.end(), number))
    return out + rest[0] + rest[1] + rest[2]


def number_of(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) - (1 << 63)


def entity_of(kind: int, value: str) -> int:
    return number_of(f"{KINDS[kind]}\x00{value}")


def term_of(word: str) -> str:
    """A word in lower case without marks at its edges."""
    return word.lower().strip(EDGES)


def class_of(term: str, word: str) -> str:
    """What a term can be generalised to."""
    if any(c.isdigit() for c in term):
        return "code" if any(c.isalpha() for c in term) else "number"
    return "name" if word.lstrip(EDGES)[:1].isupper() else "word"


def class_name(name: str) -> str:
    """What a class is counted under; no term begins like that."""
    return f"\x00{name}"


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n: documents that hold a term or a class, over the whole texts of all ``docs``."""
    def run(batches):
        held: Counter = Counter()

        def flush():
            if held:
                names = [number_of(t) for t in held]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
                held.clear()

        for batch in batches:
            for text in texts(batch):
                words = set(text.split())
                found = {term_of(w) for w in words}
                found.discard("")
                held.update(found)
                held.update(class_name(c) for c in classes_in(words))
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def classes_in(words: set[str]) -> set[str]:
    """The classes of ``words``; most texts show all that they have early."""
    out: set[str] = set()
    for w in words:
        if len(out) == len(CLASSES):
            break
        if t := term_of(w):
            out.add(class_of(t, w))
    return out


def context(text: str, base: list, common: frozenset) -> tuple[set, list]:
    """(entity, term) that stand near each other, and (term, kind, start, end) of all occurrences of these
    terms in the text. Terms in ``common`` are left out, as is what touches a base span."""
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    starts, ends = [s for s, _, _ in words], [e for _, e, _ in words]
    covered: set[int] = set()
    near: list[tuple[int, int, int]] = []
    for kind, start, end, value in base:
        first, last = bisect_left(ends, start + 1), bisect_left(starts, end)
        covered.update(range(first, last))
        near.append((entity_of(kind, value), first, last))
    names: dict[str, int | None] = {}

    def name(word: str) -> int | None:
        if word not in names:
            term = term_of(word)
            number = number_of(term) if len(term) > 1 else None
            names[word] = None if number in common else number
        return names[word]

    pairs = set()
    for entity, first, last in near:
        for i in [*range(max(0, first - CONTEXT), first), *range(last, min(len(words), last + CONTEXT))]:
            if i not in covered and (t := name(words[i][2])) is not None:
                pairs.add((entity, t))
    wanted, places = {t for _, t in pairs}, []
    if wanted:
        for i, (start, _, word) in enumerate(words):
            if i not in covered and name(word) in wanted:
                term = term_of(word)
                at = start + len(word) - len(word.lstrip(EDGES))
                kind = "general" if number_of(class_name(class_of(term, word))) in common else "removed"
                places.append((name(word), KINDS.index(kind), at, at + len(word.strip(EDGES))))
    return pairs, places


FOUND = ("_key binary, _base array<struct<kind:int,start:int,end:int>>, _entities array<bigint>, "
         "_pairs array<struct<entity:bigint,term:bigint>>, _places array<struct<term:bigint,kind:int,start:int,end:int>>")


def scan(docs: DataFrame, common: list[int], keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` with _key (a digest of the text: what a text holds depends on it alone), base
    spans, entities, pairs and places."""
    shipped = docs.sparkSession.sparkContext.broadcast(frozenset(common))

    def make():
        known = shipped.value

        def work(batch):
            out = {"_key": [], "_base": [], "_entities": [], "_pairs": [], "_places": []}
            for text in texts(batch):
                base = base_spans(text)
                pairs, places = context(text, base, known) if base else ((), ())
                out["_key"].append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                out["_base"].append([{"kind": k, "start": s, "end": e} for k, s, e, _ in base])
                out["_entities"].append(list({entity_of(k, v) for k, _, _, v in base}))
                out["_pairs"].append([{"entity": e, "term": t} for e, t in pairs])
                out["_places"].append([{"term": t, "kind": k, "start": s, "end": e} for t, k, s, e in places])
            return out

        return work

    return per_batch(docs, make, FOUND, keep=keep)


def together(found: DataFrame, item: str) -> DataFrame:
    """The elements of the array ``item`` with n, in how many rows, and n_texts, in how many different texts.
    Copies combine first, and both counts before they move."""
    rows = found.select("_key", F.explode(item).alias("x")).groupBy("x", "_key").agg(F.count("*").alias("n"))
    return rows.groupBy("x").agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"))


def revealing(found: DataFrame, counts: DataFrame, rows: int, bits: float, share: float, support: int) -> DataFrame:
    """entity, term, revealed (bits): the pairs over the thresholds."""
    pairs = together(found, "_pairs").where(F.col("n_texts") >= support).select("x.entity", "x.term", "n")
    entities = together(found, "_entities").where(F.col("n_texts") >= support).select(
        F.col("x").alias("entity"), F.col("n").alias("n_entity"))
    shown = pairs.join(entities, "entity").join(counts.select("term", F.col("n").alias("n_term")), "term")
    pmi = F.log2(F.col("n") * F.lit(float(rows)) / (F.col("n_entity") * F.col("n_term")))
    worth = F.log2(F.lit(float(rows)) / F.col("n_entity"))
    return shown.select("entity", "term", pmi.alias("revealed"), worth.alias("worth")) \
        .where((F.col("revealed") >= bits) & (F.col("revealed") >= share * F.col("worth"))).drop("worth")


def frequencies(docs: DataFrame, bits: float, support: int) -> tuple[DataFrame, list[int], int]:
    """Stored term counts (those that can reach the support), the common terms' numbers, and the rows."""
    rows = docs.select("text").count()
    counts = stored(term_counts(docs).where(F.col("n") >= support), "terms")
    least = rows * 2.0 ** -bits
    return counts, [r["term"] for r in counts.where(F.col("n") > least).select("term").collect()], rows


def revealed(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """_key and _terms, the terms that reveal an entity of the text, for texts with any."""
    held = found.where(F.size("_pairs") > 0).select("_key", F.explode("_pairs").alias("x")).select("_key", "x.entity", "x.term")
    return held.distinct().join(pairs.select("entity", "term"), ["entity", "term"], "left_semi") \
        .groupBy("_key").agg(F.collect_set("term").alias("_terms"))


def term_spans(places: str = "_places", terms: str = "_terms") -> Column:
    hits = F.filter(places, lambda p: F.array_contains(F.col(terms), p["term"]))
    hits = F.transform(hits, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    return F.coalesce(hits, F.array().cast("array<struct<kind:int,start:int,end:int>>"))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def examine(docs: DataFrame, keep: list[str], bits: float = BITS, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """``keep`` of ``docs`` (which holds ``text``; none may be called as below) with base and spans, arrays of (kind, start, end) by kind,
    then start; kinds are places in ``KINDS``, ends exclusive, both in code points.

    One row for each row. Null and blank texts have no spans; exact copies are one text for the support and
    as many documents as there are rows for the shares. An empty table gives no rows. Texts are read twice,
    for term counts and for spans; what is found is stored without them.
    """
    counts, common, rows = frequencies(docs, bits, support)
    found = stored(scan(docs, common, keep), "private")
    added = stored(revealed(found, revealing(found, counts, rows, bits, share, support)), "revealed")
    every = F.concat("_base", F.array_sort(term_spans()))
    return found.join(added, "_key", "left").select(*keep, F.col("_base").alias("base"), every.alias("spans"))


def sanitise(docs: DataFrame, bits: float = BITS, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with all columns and rows: entities become [email], [ip], [card] or [phone], revealing terms
    their class or nothing. Texts without a span, null ones among them, stay as they are."""
    counts, common, rows = frequencies(docs, bits, support)
    found = stored(scan(docs.select("text"), common, []), "private")
    added = stored(revealed(found, revealing(found, counts, rows, bits, share, support)), "revealed")
    shipped = docs.sparkSession.sparkContext.broadcast(frozenset(common))
    keyed = per_batch(with_row(docs, "text"), lambda: lambda batch: {
        "_key": [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts(batch)]}, "_key binary")
    marked = keyed.join(added, "_key", "left")

    def make():
        known = shipped.value

        def work(batch):
            terms = batch.column("_terms").to_pylist()
            return {"_clean": [clean(t, set(x or ()), known) for t, x in zip(batch.column("text").to_pylist(), terms)]}

        return work

    return per_batch(marked, make, "_clean string", keep=["_row", "_terms", "text"]).select(
        F.col("_row").withField("text", F.col("_clean")).alias("_row")).select("_row.*")


def clean(text: str | None, terms: set[int], common: frozenset) -> str | None:
    """``text`` with base spans and the given terms replaced; of spans that overlap, the first stands for all."""
    base = base_spans(text or "")
    if not base:
        return text
    spans = [(s, e, f"[{KINDS[k]}]") for k, s, e, _ in base]
    for term, kind, start, end in context(text, base, common)[1] if terms else ():
        if term in terms:
            word = text[start:end]
            spans.append((start, end, f"[{class_of(word.lower(), word)}]" if KINDS[kind] == "general" else ""))
    out, at = [], 0
    for start, end, mark in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
