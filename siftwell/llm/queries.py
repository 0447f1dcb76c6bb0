"""The queries of this package: each applies its operator to the whole intended table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import byte_pairs, disclosure, gnat, packing, periodic, quality, ring, secrets, simhash, token_counts, token_files, toxicity, vptree
from siftwell.llm.common import stored, whole
from siftwell.session import scratch_path, use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(use_utc(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.PATTERN)


@query
def op6_token_files(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path)


@query
def op7_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(
        table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op1_hash_ring_shards(spark, sf_dir):
    text = whole(F.col("text"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = ring.assign(rows, "doc_id", 40, ["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_secret_ownership(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return secrets.find(docs, F.col("doc_id"), F.col("source"))


@query
def op3_simhash_components(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_vantage_point_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op2_toxic_span_chain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "toxic_spans")


@query
def op8_perplexity_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", *quality.MEASURES)


@query
def op4_byte_pair_round_trip(spark, sf_dir):
    return byte_pairs.digests(table(spark, sf_dir, "documents"),
                              public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op13_periodic_runs(spark, sf_dir):
    docs = periodic.with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.col("runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic.find_runs(docs, keep=["doc_id"]).withColumn("best", longest).select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op11_disclosing_terms(spark, sf_dir):
    found = disclosure.examine(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *(count(k).alias(f"n_{disclosure.KINDS[k]}") for k in range(disclosure.BASE)),
        F.sha2(disclosure.written(F.col("base")), 256).alias("base_sha256"), disclosure.written(F.col("spans")).alias("spans"))


@query
def op12_product_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    coded, books = gnat.compress(vectors, "vec_id", ["vec_id", "label"])
    coded = stored(coded, "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(gnat.written(books).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def product_codes_sql(parts: int = gnat.PARTS, entries: int = gnat.ENTRIES, rounds: int = gnat.ROUNDS, scale: int = gnat.SCALE) -> str:
    """The same codes by comparing every part with every entry."""
    near = """a{r} AS MATERIALIZED (
  SELECT vec_id, label, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.label, p.part, c.entry, CAST(list_sum(list_transform(generate_series(1, len(p.v)), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT) AS d
    FROM parts p JOIN c{r} c ON p.part = c.part) GROUP BY vec_id, label, part)"""
    step = """c{n} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY i) AS v FROM (
      SELECT a.part, a.entry, i, CAST(sum(p.v[i]) // count(*) - CASE WHEN sum(p.v[i]) < 0 AND sum(p.v[i]) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS mean
      FROM a{r} a JOIN parts p ON p.vec_id = a.vec_id AND p.part = a.part, unnest(generate_series(1, len(p.v))) AS u(i)
      GROUP BY a.part, a.entry, i) GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry)"""
    found = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) AS r(part)),
c0 AS MATERIALIZED (
  SELECT part, rank - 1 AS entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM parts) WHERE rank <= {entries})"""]
    for r in range(rounds):
        found += [near.format(r=r), step.format(r=r, n=r + 1)]
    found.append(near.format(r=rounds))
    return f"""WITH {", ".join(found)},
codes AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS digest FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM codes, book"""


SQL["op12_product_codes"] = product_codes_sql()
