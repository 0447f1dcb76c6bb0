"""Tables replaced in one step, and ledgers that lose their old days."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.operators.ledger import apply_mapping, purge
from siftwell.operators.versions import Changed, VersionedTable
from siftwell.sources import folders
from siftwell.streaming.ingest import append_ledger, create_ledger, drop_expired, stored_ledger


def keys(table):
    return {r.id: r.k for r in table.read().collect()}


@pytest.fixture
def table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.createDataFrame([(1, "old"), (2, "old")], "id long, k string"))
    return table


def test_a_change_swaps_all_rows_at_once(spark, table):
    mapping = spark.createDataFrame([(2, "new")], "id long, new_value string")
    before = table.read()
    table.update(lambda rows: apply_mapping(rows, mapping, "id", "k"))
    assert keys(table) == {1: "old", 2: "new"}
    assert {r.k for r in before.collect()} == {"old"}  # a reader under way keeps its version
    table.update(lambda rows: rows.where("id = 2"))
    table.update(lambda rows: rows)
    assert keys(table) == {2: "new"}
    assert sum(n.startswith("version-") for n in folders.children(spark, table.root)) == 2


def test_a_job_that_dies_before_the_swap_changes_nothing(spark, table, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(folders, "replace_text", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.update(lambda rows: rows.withColumn("k", F.lit("new")))
    assert keys(table) == {1: "old", 2: "old"}
    with pytest.raises(Exception):  # and one that dies while it writes
        table.update(lambda rows: rows.withColumn("k", F.raise_error(F.lit("lost")).cast("string")))
    assert keys(table) == {1: "old", 2: "old"}
    table.update(lambda rows: rows.withColumn("k", F.lit("new")))
    assert keys(table) == {1: "new", 2: "new"}
    assert sum(n.startswith("version-") for n in folders.children(spark, table.root)) == 2  # left-overs are gone


def test_a_second_writer_is_told(spark, table):
    def slow(rows):
        VersionedTable(spark, table.root).update(lambda r: r.withColumn("k", F.lit("other")))
        return rows.withColumn("k", F.lit("mine"))

    with pytest.raises(Changed):
        table.update(slow)
    assert keys(table) == {1: "other", 2: "other"}


def test_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, str(tmp_path / "none")).read()


def test_old_days_lose_their_files(spark, tmp_path):
    now, path = datetime(2024, 2, 1, 12), str(tmp_path / "ledger")
    create_ledger(spark, path)
    rows = spark.createDataFrame(
        [(f"r{d}", "u", None if d is None else now - timedelta(days=d)) for d in (0, 3, 13, 14, 15, 40, None)],
        "id string, user_id string, created_at timestamp")
    rows = rows.select(*(f.name if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.LEDGER))
    append_ledger(rows, path, 0)
    append_ledger(rows.where("id = 'r3'").withColumn("id", F.lit("again")), path, 1)
    read = sorted(r.id for r in purge(stored_ledger(spark, path), F.lit(now))[0].collect())
    assert drop_expired(spark, path, F.lit(now)) == ["day=2023-12-23", "day=2024-01-17"]
    files = {p.parent.parent.name for p in (tmp_path / "ledger").rglob("*.parquet")}
    assert files == {"day=2024-02-01", "day=2024-01-29", "day=2024-01-19", "day=2024-01-18", "day=__HIVE_DEFAULT_PARTITION__"}
    assert sorted(r.id for r in purge(stored_ledger(spark, path), F.lit(now))[0].collect()) == read
    append_ledger(rows.where("id = 'r3'").withColumn("id", F.lit("again")), path, 1)  # a repeated micro-batch
    assert sorted(r.id for r in purge(stored_ledger(spark, path), F.lit(now))[0].collect()) == read == ["again", "r0", "r13", "r14", "r3", "rNone"]
    assert drop_expired(spark, path, F.lit(now)) == []
