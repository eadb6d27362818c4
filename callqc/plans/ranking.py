"""Distributed 1..n numbering of a relation in a total order.

``row_number() OVER (ORDER BY ...)`` without PARTITION BY moves every row into one task.
Here the rows are grouped into buckets that follow the order (the hour of a time, the whole
points of a score): a bucket's rows are numbered among themselves, and the counts of the
earlier buckets are added.  The counts are one small row per bucket (hours of history, points
of a scale), so they and their broadcast do not grow with the rows.  Nothing is sampled and
no job runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_offsets(df: DataFrame, bucket: Column, bucket_order: Column) -> DataFrame:
    """``_b, _n, _offset``: each bucket's rows and the rows of all buckets before it."""
    counts = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))


def number_in_buckets(df: DataFrame, order: Sequence[Column], bucket: Column, offsets: DataFrame, name: str) -> DataFrame:
    """Rows of the buckets in ``offsets`` with ``name``, their BIGINT position in ``order``."""
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        df.withColumn("_bucket", bucket)
        .join(F.broadcast(offsets), F.col("_bucket").eqNullSafe(F.col("_b")))
        .withColumn(name, F.col("_offset") + own.cast("bigint"))
        .drop("_bucket", "_b", "_n", "_offset")
    )


def global_row_number(df: DataFrame, order: Sequence[Column], bucket: Column, bucket_order: Column,
                      name: str = "rank") -> DataFrame:
    """Add ``name`` = position (1-based BIGINT) of each row in ``order``; ties must be broken by ``order``.

    ``bucket`` must follow the order: rows of an earlier bucket (by ``bucket_order``, an
    ordering of the column ``_b``) come before those of a later one.
    """
    return number_in_buckets(df, order, bucket, bucket_offsets(df, bucket, bucket_order), name)
