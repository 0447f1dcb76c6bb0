"""One batch of the service for all users: read, stage, evaluate, record, deliver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.inference import ModelFn
from siftwell.operators.ledger import attach_ids, description_objects, id_map, insert_if_absent
from siftwell.operators.normalize import to_ledger_rows
from siftwell.plans.cascade import (
    audit_rows, classify, evaluate, funnel, outcome, stage_postings, survivors, with_silent_users, with_texts,
)
from siftwell.session import materialize


@dataclass(frozen=True)
class BatchResult:
    """Frames of one run. ``evaluated`` has ids; ``inserted`` are the rows to append."""

    staged: DataFrame
    evaluated: DataFrame
    inserted: DataFrame
    runs: DataFrame
    descriptions: DataFrame


def run_batch(postings: DataFrame, users: DataFrame, ledger: DataFrame, fn: ModelFn, now: Column,
              batch_size: int = 5, parallelism: int | None = None, present: DataFrame | None = None
              ) -> BatchResult:
    """Run the cascade over landed postings.

    ``present`` (see ``users_with_files``) names the users that had files; those without a readable
    posting then get their audit row as well.

    Postings are staged on keys, orders and stages alone; texts are fetched for survivors. Results are written once to the
    shared folder where several consumers need them and they must not be computed twice: the staged
    postings, and the model's answers (a model may answer differently when asked again).
    """
    staged = materialize(stage_postings(classify(postings, users, now), ledger), "staged")
    evaluated = materialize(
        evaluate(with_texts(survivors(staged), postings), users, fn, batch_size, parallelism), "evaluated")

    rows = to_ledger_rows(evaluated).withColumns({
        "created_at": now, "updated_at": now,
        "description_key": F.lit(None).cast("string"), "resume_key": F.lit(None).cast("string"),
    })
    inserted = materialize(insert_if_absent(rows, ledger), "inserted")
    ids = id_map(rows, inserted, ledger)
    # ids are looked up on the keys alone; the wide rows then move once
    keys = evaluated.select("user_id", "fingerprint", F.col("link").alias("job_link"))
    with_ids = evaluated.join(attach_ids(keys, ids), ["user_id", "fingerprint"], "left")

    counts = funnel(staged)
    if present is not None:
        active = users.filter(F.col("is_active")).select(F.col("id").alias("user_id"))
        counts = with_silent_users(counts, present.join(active, "user_id", "left_semi"))
    runs = audit_rows(counts, outcome(evaluated), now)
    matched = with_ids.filter(F.col("status") == "matched")
    descriptions = description_objects(matched)
    return BatchResult(staged, with_ids, inserted, runs, descriptions)
