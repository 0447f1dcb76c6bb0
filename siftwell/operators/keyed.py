"""Keyed work that stays parallel when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _columns(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in the given (total) order.

    ``row_number() <= 1`` is planned with a group limit below the exchange, so every map task sends
    at most one row per key: a key held by a third of the input does not reach one task as such.
    """
    return top_per_key(df, keys, order, 1, "_rank").drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of each key with their rank; ``n`` is the size of a report page."""
    window = Window.partitionBy(*keys).orderBy(*_columns(order))
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def rank_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Sequence, rank: str
) -> DataFrame:
    """Exact rank 1..n of every row inside its key, without one task per key.

    ``bucket`` lists columns that never decrease along ``order`` (a date for a timestamp, a block
    number for an id), so buckets follow each other in rank order. Rows are ranked inside
    (key, bucket); the number of rows in earlier buckets is added from a small table of bucket
    counts. The window therefore never sees more than one bucket of a key, and join and window
    share one exchange. Keys and buckets must not be null.
    """
    names = [f"_bucket{i}" for i in range(len(bucket))]
    marked = df.withColumns(dict(zip(names, _columns(bucket))))
    group = [*keys, *names]
    earlier = Window.partitionBy(*keys).orderBy(*names).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    inside = Window.partitionBy(*group).orderBy(*_columns(order))
    return (
        marked.join(offsets.drop("_rows"), group, "left")
        .withColumn(rank, (F.row_number().over(inside) + F.col("_offset")).cast("bigint"))
        .drop(*names, "_offset")
    )


def split_buckets(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
                  limit: int, parts: int = 64) -> tuple[DataFrame, Column]:
    """``df`` with column _cuts, and the number of a row's range among them as a further bucket.

    Needed where a bucket holds many rows of one moment, which no time bucket splits. Buckets of more than
    ``limit`` rows that share all but the last ``order`` column are cut into ``parts`` ranges of that one, at
    approximate quantiles (ranges must not decrease along the order, so others stay whole). Values that are
    not numbers are left as they are.
    """
    by = order[-1]
    if not isinstance(df.schema[by].dataType, T.NumericType):
        return df.withColumn("_cuts", F.lit(None).cast("array<bigint>")), F.lit(0)
    marked, group = df.withColumn("_moment", bucket), [*keys, "_moment"]
    sizes = marked.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *(f(c).alias(f"_{n}_{c}") for c in order[:-1]
                                                                       for n, f in (("low", F.min), ("high", F.max))))
    for c in order[:-1]:
        sizes = sizes.where(F.col(f"_low_{c}") == F.col(f"_high_{c}"))
    big = sizes.where(F.col("_n") > limit).select(*group)
    cuts = marked.join(big, group, "left_semi").groupBy(*group).agg(
        F.percentile_approx(by, [i / parts for i in range(1, parts)], 10_000).alias("_cuts"))
    return marked.join(cuts, group, "left").drop("_moment"), F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(by))), F.lit(0))


def batch_number(rank: Column, size: int) -> Column:
    """1-based number of the fixed-size batch a rank falls into."""
    return (F.floor((rank - 1) / size) + 1).cast("bigint")


def attach(rows: DataFrame, attributes: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join many rows to one attribute row each.

    One plan for all sizes: Spark broadcasts attributes it sizes under the threshold, and otherwise joins
    by key, where adaptive execution splits the partition of a hot key by its rows. Attributes are never
    repeated.
    """
    return rows.join(attributes, on, how)
