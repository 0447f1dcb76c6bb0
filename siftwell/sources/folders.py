"""Folders of tables on shared storage: listing, removal, and text files replaced in one step.

All calls go through Hadoop's file system interface, so paths of any scheme Spark can read work. They
move names only; data stays with Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    where, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.delete(where, True)


def set_time(spark: SparkSession, path: str, ms: int) -> None:
    where, fs = _at(spark, path)
    fs.setTimes(where, ms, -1)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Give ``path`` this content in one step: readers see the old or the new one, never a part."""
    where, fs = _at(spark, f"{path}.new")
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()) \
        if where.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    context.rename(where, jvm.org.apache.hadoop.fs.Path(path), how)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, None where there is none."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def drop_days(spark: SparkSession, path: str, before: str, column: str = "day") -> list[str]:
    """Remove the partitions ``column=YYYY-MM-DD`` of days before ``before``, whole; returns their names.

    Days are compared as texts of that form; other folders stay."""
    gone = [name for name in children(spark, path)
            if re.fullmatch(rf"{column}=\d{{4}}-\d\d-\d\d", name) and name < f"{column}={before}"]
    for name in gone:
        delete(spark, f"{path}/{name}")
    return gone
