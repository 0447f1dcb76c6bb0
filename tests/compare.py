"""Run queries next to their SQL twins and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        ([plain(r[i]) for i in order] for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    extra = [g for g in map(repr, got[1]) if g not in set(map(repr, want[1]))] if got[1] != want[1] else []
    if extra:
        wanted = set(map(repr, got[1]))
        missing = [w for w in map(repr, want[1]) if w not in wanted]
        return f"{len(extra)} rows differ\n   got {extra[0]}\n  want {missing[0]}"
    return None


if __name__ == "__main__":
    from siftwell.session import build_session
    import __spark_entry__ as entry

    sf = "/root/testdata/" + sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle(sf), 0
    for name in names:
        start = time.time()
        try:
            got = spark_rows(entry.queries()[name](spark, sf))
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            diff = difference(got, sql_rows(con, sql)) if sql else "no sql"
        except Exception as error:  # report and go on
            diff, took, got = f"{type(error).__name__}: {str(error)[:700]}", time.time() - start, ([], [])
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {len(got[1])} rows {took:.1f}s {diff or ''}", flush=True)
    print("bad:", bad, "of", len(names))
