"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftwell.session import scratch_path
from siftwell.sources import folders


def whole(text: Column) -> Column:
    """A text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: used twice, it is computed once, and what
    reads it survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table after its last reader has run."""
    for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
        folders.delete(df.sparkSession, folder)


def trim() -> None:
    """Give memory that this process no longer uses back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if give:
        give(0)


def released(run):
    """The function of ``mapInArrow``, before and after which its worker gives memory it no longer uses back
    to the system. Workers are kept between tasks, and what one stage of a long job needed would otherwise
    stay beside what the next one needs."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], added: str,
              keep: list[str] | None = None, name: str = "text", prune: bool = True,
              tidy: bool = False) -> DataFrame:
    """Columns ``keep`` (all by default) and those of the schema ``added``, computed batch by batch.

    ``make`` runs once in each task and returns the function from a record batch to the values of the new
    columns. ``name`` is the column that counts as the text; it is taken along only if kept. Columns that are
    not needed are not read, unless rows have to be dealt to tasks as by another plan (``prune``). ``tidy`` is for stages of long jobs.
    """
    kept = df.columns if keep is None else keep
    new = T._parse_datatype_string(added)
    fields = [df.schema[c] for c in kept] + [T.StructField(f.name, f.dataType) for f in new.fields]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            got = work(batch)
            columns = [batch.column(c).cast(arrow.field(c).type) for c in kept]
            columns += [pa.array(got[f.name], arrow.field(f.name).type) for f in new.fields]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return (df.select(*dict.fromkeys([*kept, name])) if prune else df).mapInArrow(released(run) if tidy else run, schema)


def with_row(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` and _row, all columns of ``docs``: extra ones go along without meeting the operator's own."""
    return docs.select(*columns, F.struct(*docs.columns).alias("_row"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def each_text(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """As ``texts``, but one text at a time is taken from Arrow."""
    return (t.as_py() or "" for t in batch.column(name))


def conf(spark: SparkSession, key: str, default: str) -> int:
    return int(spark.conf.get(key, default))
