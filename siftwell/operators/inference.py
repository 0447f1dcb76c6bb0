"""Batched model calls, and safe reading of what comes back."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.text import col, truncate

USAGE = ["cache_hit_tokens", "cache_miss_tokens", "completion_tokens", "reasoning_tokens", "cost_usd"]


class FatalModelError(Exception):
    """Raised by a model function to fail the job instead of falling back."""


ModelFn = Callable[[dict, list[dict]], dict]


#: Calls a task has under way at a time, attempts after a failed one, and the first pause before them in seconds.
IN_FLIGHT, RETRIES, PAUSE = 25, 1, 0.2
ANSWER = T.StructType([T.StructField("model_json", T.StringType())] + [
    T.StructField(n, T.DoubleType() if n == "cost_usd" else T.LongType()) for n in USAGE])


def call_model(
    df: DataFrame, fn: ModelFn, payload: str, context: str | None = None, group: str = "user_id",
    order: str = "ord", batch_size: int = 5, parallelism: int | None = None, in_flight: int = IN_FLIGHT,
    retries: int = RETRIES, pause: float = PAUSE,
) -> DataFrame:
    """Add ``model_json`` and usage columns by calling ``fn`` on small batches of rows.

    ``fn(context, items)`` gets the group's context (parsed JSON, or {}) and a list of payload dicts
    with an ``id``; it returns ``{"results": [{"id": ..., ...}], "usage": {...}}``. It is called from several
    threads, ``in_flight`` at a time in each task; answers go back to their rows whatever order they come in.
    A failing call is tried again after a pause that doubles and varies; a batch that keeps failing is
    retried row by row; a row that still fails, or that the answer leaves out, gets null. Usage is booked
    on the first row of a call, so plain sums give the totals.

    Rows are spread by (group, hash of order), so one group's rows reach many tasks; within a task
    they are sorted by group, which keeps the constant part of prompts together. The number of tasks follows
    the size of the data, unless ``parallelism`` states it. Only group, payload and context go through Arrow.
    """
    spread = [F.col(group), F.pmod(F.xxhash64(order), F.lit(1024))]
    parts = df.repartition(parallelism, *spread) if parallelism else df.repartition(*spread)

    def ask(ctx: dict, items: list[dict]) -> tuple[dict, dict]:
        for attempt in range(retries + 1):
            try:
                answer = fn(ctx, items)
                return {r["id"]: r for r in answer.get("results", []) if "id" in r}, answer.get("usage") or {}
            except FatalModelError:
                raise
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(pause * 2 ** attempt * (0.5 + random.random()))
        raise AssertionError

    def run_batch(ctx: dict, payloads: list[dict]) -> list[tuple[str | None, dict]]:
        out: list[tuple[str | None, dict]] = [(None, {})] * len(payloads)
        items = [{"id": i, **p} for i, p in enumerate(payloads)]
        try:
            found, used = ask(ctx, items)
            for i in range(len(items)):
                out[i] = (json.dumps(found[i]) if i in found else None, used if i == 0 else {})
        except FatalModelError:
            raise
        except Exception:
            for i, item in enumerate(items):
                try:
                    found, used = ask(ctx, [item])
                    first = next(iter(found.values()), None)
                    out[i] = (json.dumps(first) if first is not None else None, used)
                except FatalModelError:
                    raise
                except Exception:
                    out[i] = (None, {})
        return out

    def calls(keys: pd.Series, texts: pd.Series, contexts: pd.Series) -> Iterator[tuple[list[int], dict, list[dict]]]:
        """Places of the rows, context and payloads of each call."""
        frame = pd.DataFrame({"key": keys.to_numpy(), "at": range(len(keys))})
        for _, rows in frame.groupby("key", sort=False, dropna=False):
            at = rows["at"].tolist()
            ctx = json.loads(contexts.iloc[at[0]]) if context else {}
            for start in range(0, len(at), batch_size):
                part = at[start:start + batch_size]
                yield part, ctx, [json.loads(texts.iloc[i]) for i in part]

    @F.pandas_udf(ANSWER)
    def answers(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for keys, texts, contexts in frames:
                under_way = [(at, pool.submit(run_batch, ctx, payloads)) for at, ctx, payloads in calls(keys, texts, contexts)]
                got: list[tuple[str | None, dict]] = [(None, {})] * len(keys)
                try:
                    for at, call in under_way:
                        for i, answer in zip(at, call.result()):
                            got[i] = answer
                except BaseException:
                    for _, call in under_way:
                        call.cancel()
                    raise
                yield pd.DataFrame({"model_json": [text for text, _ in got], **{
                    n: pd.Series([used.get(n) or 0 for _, used in got], dtype="float64" if n == "cost_usd" else "int64")
                    for n in USAGE}})

    # an answer may differ when asked for again, so the plan must not ask twice
    asked = answers.asNondeterministic()(F.col(group), F.col(payload), F.col(context) if context else F.lit("{}"))
    return parts.sortWithinPartitions(group, order).withColumn("_answer", asked).select(
        *df.columns, *(F.col(f"_answer.{f.name}").alias(f.name) for f in ANSWER))


# --- reading answers -------------------------------------------------------------------

def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _part(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, F.lit(f"$.{name}"), "variant")


def text_field(doc: Column, name: str) -> Column:
    """The field when it is a text, else null."""
    part = _part(doc, name)
    return F.when(_kind(part) == "STRING", F.try_variant_get(doc, F.lit(f"$.{name}"), "string"))


def flag_field(doc: Column, name: str) -> Column:
    part = _part(doc, name)
    got = F.when(_kind(part) == "BOOLEAN", F.try_variant_get(doc, F.lit(f"$.{name}"), "boolean"))
    return F.coalesce(got, F.lit(False))


def list_field(doc: Column, name: str) -> Column:
    """The field when it is a list of texts, else an empty list."""
    part = _part(doc, name)
    got = F.when(_kind(part) == "ARRAY<STRING>",
                 F.try_variant_get(doc, F.lit(f"$.{name}"), "array<string>"))
    return F.coalesce(got, F.array().cast("array<string>"))


def number_field(doc: Column, name: str) -> Column:
    """A number, or the number a text starts with ("3+" gives 3); anything else is null."""
    part = _part(doc, name)
    text = F.try_variant_get(doc, F.lit(f"$.{name}"), "string")
    lead = F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    kind = _kind(part)
    plain = F.when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(
        text.try_cast("double"))
    return F.when(kind == "STRING", lead.try_cast("double")).when(
        ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT"), plain)


def parse_facts(model_json) -> Column:
    """Facts struct from an answer. A field of the wrong type takes its default; the row survives,
    also when the whole answer is missing or not JSON."""
    doc = F.try_parse_json(col(model_json))
    return F.struct(
        text_field(doc, "job_domain").alias("job_domain"),
        number_field(doc, "min_required_yoe").alias("min_required_yoe"),
        number_field(doc, "max_required_yoe").alias("max_required_yoe"),
        list_field(doc, "required_skills").alias("required_skills"),
        list_field(doc, "preferred_skills").alias("preferred_skills"),
        list_field(doc, "candidate_matched_required_skills").alias("candidate_matched_required_skills"),
        list_field(doc, "candidate_matched_preferred_skills").alias("candidate_matched_preferred_skills"),
        flag_field(doc, "domain_matches_candidate").alias("domain_matches_candidate"),
        text_field(doc, "job_location").alias("job_location"),
        text_field(doc, "direct_apply").alias("direct_apply"),
    )


def usage_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Token and cost sums per key; a missing cost counts as 0."""
    money = F.sum(F.coalesce(F.col("cost_usd"), F.lit(0)).cast("decimal(28,10)")).cast("double")
    return df.groupBy(*keys).agg(*[
        (money if n == "cost_usd" else F.sum(F.coalesce(F.col(n), F.lit(0)))).alias(n) for n in USAGE])


# --- resumes -----------------------------------------------------------------------------

def limited(column: str, chars: int | None) -> Column:
    """A model's input limit, if the caller states one; texts are sent whole otherwise."""
    return F.col(column) if chars is None else truncate(column, chars)


def extract_profiles(resumes: DataFrame, fn: ModelFn, parallelism: int | None = None,
                     most_chars: int | None = None) -> DataFrame:
    """Structured profile of each resume (user_id, text). Rows the model fails on keep a null
    profile. ``most_chars`` is the model's own input limit, if it has one."""
    from siftwell.schemas import PROFILE

    sent = resumes.withColumn("payload", F.to_json(F.struct(
        limited("text", most_chars).alias("resume"))))
    out = call_model(sent, fn, "payload", group="user_id", order="user_id", batch_size=1,
                     parallelism=parallelism)
    return out.withColumn("profile", F.from_json("model_json", PROFILE)).drop("payload", "model_json")


def tailored_resumes(jobs: DataFrame, existing: DataFrame, fn: ModelFn, parallelism: int | None = None,
                     most_resume_chars: int | None = None, most_description_chars: int | None = None) -> DataFrame:
    """Tailored resume per ledger row that has none yet.

    ``jobs`` carries id, user_id, job_title, company_name, resume_text, description_text,
    matched_skills, name and email. Rows already present in ``existing`` (id), or without resume or
    description, are left out before any model call.
    """
    from siftwell.functions.render import resume_markdown
    from siftwell.functions.text import first_truthy, truthy
    from siftwell.schemas import RESUME

    todo = jobs.join(existing.select("id"), "id", "left_anti").filter(
        truthy("resume_text").isNotNull() & truthy("description_text").isNotNull())
    sent = todo.withColumn("payload", F.to_json(F.struct(
        limited("resume_text", most_resume_chars).alias("resume"),
        limited("description_text", most_description_chars).alias("description"),
        first_truthy("job_title", default="Job Role").alias("title"),
        first_truthy("company_name", default="Company").alias("company"),
        F.col("matched_skills").alias("skills"))))
    out = call_model(sent, fn, "payload", group="user_id", order="id", batch_size=1, parallelism=parallelism)
    out = out.withColumn("resume", F.from_json("model_json", RESUME))
    return out.withColumn("resume_md", F.when(
        F.col("resume").isNotNull(), resume_markdown("resume", "name", "email"))
    ).drop("payload", "model_json")
