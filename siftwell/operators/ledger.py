"""The ledger: insert-if-absent, ids, descriptions, purge, mappings, exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.constants import RETENTION_DAYS
from siftwell.functions.text import truthy
from siftwell.operators.keyed import first_per_key
from siftwell.sources import folders


def ledger_id(user="user_id", fp="fingerprint", link="job_link") -> Column:
    """Row id derived from the row's key, so a re-run gives the same id."""
    return F.sha2(F.concat_ws("|", F.col(user).cast("string"), F.coalesce(F.col(fp), F.col(link))), 256)


def last_per_link(new: DataFrame, order: str = "ord") -> DataFrame:
    """(user_id, job_link, _last, _first): the places of the last and the first row of each link.

    The last row's values count, at the first row's position."""
    return new.groupBy("user_id", "job_link").agg(F.max(order).alias("_last"), F.min(order).alias("_first"))


def insert_if_absent(new: DataFrame, ledger: DataFrame, order: str = "ord") -> DataFrame:
    """Rows to append: neither their (user, link) nor their (user, fingerprint) exists.

    Existing rows are excluded first, then the first of the remaining rows per fingerprint wins;
    links are unique by then, so the result equals row-by-row insertion in input order. A null
    fingerprint never conflicts. ``order`` tells a user's rows apart.

    All of this is decided on keys and orders; the other columns of ``new`` are joined to the winners last,
    so they move once or, where the winners are few, not at all.
    """
    def at(side: str) -> Column:  # a link may be null, and then is a link of its own
        return (F.col("user_id") == F.col("_user")) & F.col("job_link").eqNullSafe(F.col("_link")) & (F.col(order) == F.col(side))

    light = new.select("user_id", "job_link", order, "fingerprint")
    last = last_per_link(new, order).withColumnsRenamed({"user_id": "_user", "job_link": "_link"})
    rows = light.join(last, at("_last")).drop("_user", "_link", "_last")
    rows = rows.join(ledger.select("user_id", "job_link"), ["user_id", "job_link"], "left_anti")
    # a row without fingerprint is its own key; existing keys and first-wins then share an exchange
    content = F.concat(F.lit("f:"), "fingerprint")
    rows = rows.withColumn("_key", F.coalesce(content, F.concat(F.lit("l:"), "job_link")))
    known = ledger.select("user_id", content.alias("_key"))
    rows = rows.join(known, ["user_id", "_key"], "left_anti")
    winners = first_per_key(rows, ["user_id", "_key"], ["_first"]).select(
        F.col("user_id").alias("_user"), F.col("job_link").alias("_link"), F.col(order).alias("_order"), "_first")
    found = new.join(winners, at("_order")).withColumn(order, F.col("_first")).drop("_user", "_link", "_order", "_first")
    return found.withColumn("id", ledger_id())


def id_map(new: DataFrame, inserted: DataFrame, ledger: DataFrame) -> DataFrame:
    """(user_id, job_link, fingerprint, id) entries usable for the rows of this call: what was
    inserted, and existing rows found by link. An existing row that matches by fingerprint only is
    not looked up."""
    columns = ["user_id", "job_link", "fingerprint", "id"]
    links = new.select("user_id", "job_link").distinct()
    existing = ledger.select(columns).join(links, ["user_id", "job_link"], "left_semi")
    return inserted.select(columns).unionByName(existing)


def attach_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Add ``ledger_id``: by link, else by fingerprint, else null."""
    by_link = ids.select("user_id", "job_link", F.col("id").alias("_by_link"))
    by_print = ids.filter(F.col("fingerprint").isNotNull()).select(
        "user_id", "fingerprint", F.col("id").alias("_by_print"))
    return (
        rows.join(by_link, ["user_id", "job_link"], "left")
        .join(by_print, ["user_id", "fingerprint"], "left")
        .withColumn("ledger_id", F.coalesce("_by_link", "_by_print"))
        .drop("_by_link", "_by_print")
    )


def description_key(user="user_id", row_id="ledger_id", folder: str = "job-descriptions") -> Column:
    return F.concat(F.lit(f"{folder}/"), F.col(user).cast("string"), F.lit("/"), F.col(row_id), F.lit(".txt"))


def description_objects(matched: DataFrame) -> DataFrame:
    """(user_id, ledger_id, key, text) of matched rows that have both a text and an id."""
    has_both = truthy("description_text").isNotNull() & F.col("ledger_id").isNotNull()
    return matched.filter(has_both).select(
        "user_id", "ledger_id", description_key().alias("key"), F.col("description_text").alias("text"))


def write_texts(objects: DataFrame, path: str, row_id: str, run: str | None = None, waves: int = 1) -> DataFrame:
    """Write text objects as ``<path>/run=<run>/wave=<n>`` and return (``row_id``, key) of what is there.

    Ids are dealt to ``waves`` by hash and a wave that is written is noted in ``<path>/_runs/<run>``; a run
    that is repeated under its name after a failure skips the noted waves and replaces the others, so no
    object is there twice. Without a name a run is a new one. Files hold rows in the order they come, of as
    many users as there are: texts are not moved to be written.
    """
    spark, run = objects.sparkSession, run or uuid.uuid4().hex
    done = set(json.loads(folders.read_text(spark, f"{path}/_runs/{run}") or "[]"))
    for wave in range(waves):
        if wave not in done:
            part = objects.where(F.pmod(F.xxhash64(row_id), F.lit(waves)) == wave) if waves > 1 else objects
            part.write.mode("overwrite").parquet(f"{path}/run={run}/wave={wave}")
            done.add(wave)
            folders.replace_text(spark, f"{path}/_runs/{run}", json.dumps(sorted(done)))
    return spark.read.schema(objects.schema).parquet(f"{path}/run={run}/wave=*").select(row_id, "key")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Objects of all waves that are noted as written."""
    noted = {run: json.loads(folders.read_text(spark, f"{path}/_runs/{run}") or "[]") for run in folders.children(spark, f"{path}/_runs")
             if not run.startswith(".") and not run.endswith(".new")}
    return spark.read.parquet(*(f"{path}/run={run}/wave={w}" for run, waves in noted.items() for w in waves))


def store_descriptions(matched: DataFrame, path: str, run: str | None = None, waves: int = 1) -> DataFrame:
    """Write the descriptions apart from the ledger (long text stays out of the hot table) and
    return the (id, key) mapping to apply to it, as read back from what was written."""
    written = write_texts(description_objects(matched), path, "ledger_id", run, waves)
    return written.select(F.col("ledger_id").alias("id"), F.col("key").alias("new_value"))


def purge(ledger: DataFrame, now: Column, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count of removed ones). Rows created before ``now - days`` go;
    those without a creation time stay.

    On a table partitioned by creation date the same predicate prunes whole partitions.
    """
    expired = F.col("created_at") < now - F.expr(f"INTERVAL {int(days)} DAYS")
    return ledger.filter(F.col("created_at").isNull() | ~expired), ledger.filter(expired).agg(F.count(F.lit(1)).alias("removed"))


def apply_mapping(df: DataFrame, mapping: DataFrame, key: str, column: str) -> DataFrame:
    """Set ``column`` from a (key, new_value) mapping; rows without an entry keep their value."""
    return (
        df.join(mapping.select(F.col(key), F.col("new_value").alias("_new")), key, "left")
        .withColumn(column, F.coalesce("_new", column)).drop("_new")
    )


def export_status(rows: DataFrame, done: DataFrame, id_col: str = "id", text: str = "text",
                  user: str = "user_id") -> DataFrame:
    """Add ``export_status``: skipped (no text or owner), already_done, or upload."""
    marks = done.select(id_col).distinct().withColumn("_done", F.lit(True))
    missing = truthy(text).isNull() | F.col(id_col).isNull() | F.col(user).isNull()
    return rows.join(marks, id_col, "left").withColumn(
        "export_status",
        F.when(missing, "skipped").when(F.col("_done"), "already_done").otherwise("upload"),
    ).drop("_done")


def export_pending(rows: DataFrame, done: DataFrame, path: str, id_col: str = "id", text: str = "text",
                   user: str = "user_id", run: str | None = None, waves: int = 1) -> DataFrame:
    """Write what is not exported yet and return the new (id, key) entries, read back from what was written.
    Running it again with the grown ``done`` table writes nothing twice, nor does repeating a ``run`` that failed.

    What is to be written is decided on ids; texts are joined to them."""
    light = rows.select(id_col, user, truthy(text).isNotNull().alias(text)).where(text).withColumn(text, F.lit("there"))
    todo = export_status(light, done, id_col, text, user).filter(F.col("export_status") == "upload").select(id_col)
    out = rows.join(todo, id_col, "left_semi").where(truthy(text).isNotNull()).select(
        F.col(id_col), F.col(user).alias("user_id"), description_key(user, id_col).alias("key"), F.col(text).alias("text"))
    return write_texts(out, path, id_col, run, waves)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove deleted users from every table; ``tables`` maps name to (frame, user column)."""
    out = {}
    for name, (frame, column) in tables.items():
        out[name] = frame.join(gone.select(F.col("user_id").alias(column)), column, "left_anti")
    return out


def hex_id(c: str) -> Column:
    """Integer id as a 32-digit zero-padded hex text with uuid dashes."""
    h = F.lpad(F.lower(F.hex(F.col(c))), 32, "0")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def migrate(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """Apply schema steps in order: ("cast", col, type), ("hex_id", col), ("rename", old, new),
    ("drop", col), ("add", col, type, default)."""
    for kind, column, *args in steps:
        if kind == "cast":
            df = df.withColumn(column, F.col(column).cast(args[0]))
        elif kind == "hex_id":
            df = df.withColumn(column, hex_id(column))
        elif kind == "rename":
            df = df.withColumnRenamed(column, args[0])
        elif kind == "drop":
            df = df.drop(column)
        elif kind == "add":
            value = F.array().cast(args[0]) if args[1] == [] else F.lit(args[1]).cast(args[0])
            df = df.withColumn(column, value)
        else:
            raise ValueError(f"unknown step {kind}")
    return df
