"""Positions in a total order, and the next event after a position: no task sees a whole key.

``ordinal`` numbers a relation 1..n: the rows are sorted by ranges and written, a row's place is
its place in its part plus the rows of the parts before (one count per part), so it neither
gathers the rows nor any group of them.  ``next_position`` looks up the next event of a key in
blocks of positions, so a key that holds a third of all rows is still read by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callqc.plans.stored import written

#: Positions of a block: as many rows of one key as one task sorts.
BLOCK = 1 << 16
_IN_PART = 33  # bits of a row's place in its part, by ``monotonically_increasing_id``


def ordinal(df: DataFrame, order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 ... (BIGINT) in ``order``, rows of equal order by all their
    columns.  Written to the shared folder.  Equal rows take neighbouring numbers."""
    own = [c.name for c in df.schema.fields if c.dataType.simpleString().split("<")[0] not in ("map", "variant")]
    row = _free(df, "row")
    rows = df.withColumn(row, F.monotonically_increasing_id())  # parts equal rows, which any task may hold
    return as_listed(rows.orderBy(*order, *(F.col(f"`{c}`") for c in own), row).drop(row), name)


def as_listed(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 ... (BIGINT) in the order in which its rows come, such as that of
    a sorted listing.  Written to the shared folder."""
    place = _free(df, "place")
    placed = written(df.withColumn(place, F.monotonically_increasing_id()), "ordinal")
    part = F.shiftrightunsigned(place, _IN_PART)
    parts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.col(place).bitwiseAND(F.lit((1 << _IN_PART) - 1)) + 1
    # as many rows as the sort has parts
    return placed.join(F.broadcast(before), part == F.col("_part")).select(*(F.col(f"`{c}`") for c in df.columns), number.alias(name))


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def next_position(rows: DataFrame, events: DataFrame, block: int | None = None) -> DataFrame:
    """``key, at, next`` for every distinct ``key, at`` of ``rows``: the first ``at`` of the key's
    ``events`` after it, or null.

    Positions of a key's events must be distinct numbers (as ``ordinal`` gives them), so a key
    has at most ``block`` events in a block and one row for each block.
    """
    width = F.lit(block or BLOCK)
    asked = rows.select("key", "at").distinct().select("key", "at", F.lit(None).cast("long").alias("event"))
    both = asked.unionByName(events.select("key", "at", F.col("at").cast("long").alias("event"))).withColumn("block", F.floor(F.col("at") / width))
    later = Window.partitionBy("key", "block").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.min("event").over(later)).where("event IS NULL").select("key", "at", "block", "near")
    blocks = both.groupBy("key", "block").agg(F.min("event").alias("first"))
    beyond = Window.partitionBy("key").orderBy(F.col("block").desc()).rangeBetween(Window.unboundedPreceding, -1)
    far = blocks.withColumn("far", F.min("first").over(beyond)).select("key", "block", "far").where("far IS NOT NULL")
    return near.join(far, ["key", "block"], "left").select("key", "at", F.coalesce("near", "far").alias("next"))
