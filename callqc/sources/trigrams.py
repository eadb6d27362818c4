"""A stored trigram index of call ids for substring search.

The index has a row for every call and every three letters in a row of its lower-cased
``unique_id``, partitioned by a hash of the three letters and sorted by them, and beside it how
many calls have each.  A search reads the rows of its rarest trigrams, keeps the calls that have
all of them, and so names the calls (and the days of the call log) that can match; the ILIKE of
the search then decides as it does without an index, wildcards included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callqc.functions.filters import PARTITION_COLUMN

#: Partitions of the index, and trigrams that a search looks up.
PARTS, LOOKED_UP = 64, 4


def literal_runs(search: str) -> list[str]:
    """The pieces of a search text that must stand in an id as they are: what lies between its
    wildcards ``%`` and ``_``; a backslash takes a wildcard, or itself, literally."""
    runs = [""]
    for escaped, c in re.findall(r"(\\?)(.)", search.strip(), flags=re.S):
        if c in "%_" and not escaped:
            runs.append("")
        else:
            runs[-1] += c
    return [r for r in runs if r]


def trigrams(search: str) -> set[str]:
    """Trigrams that every id found by a search text has."""
    return {r.lower()[k : k + 3] for r in literal_runs(search) for k in range(len(r.lower()) - 2)}


def write_index(calls: DataFrame, path: str, id_col: str = "id", text_col: str = "unique_id") -> None:
    """Write the index of a call log to ``path``.  Ids of fewer than three letters have no rows: only
    searches of fewer letters, which use no index, can find them."""
    text = F.lower(F.col(text_col))
    day = F.to_date("created_at") if "created_at" in calls.columns else F.lit(None).cast("date")
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda k: F.substring(text, k, F.lit(3)))
    rows = calls.where(F.length(text) >= 3).select(F.explode(F.array_distinct(grams)).alias("gram"), F.col(id_col).alias("id"), day.alias("day"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int"))
    # a trigram of every id is many rows of one part: parts are split by their size
    rows.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/grams")
    stored = calls.sparkSession.read.parquet(f"{path}/grams")
    stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/counts")


@dataclass(frozen=True)
class TrigramIndex:
    """A written index."""

    grams: DataFrame
    counts: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> TrigramIndex:
        return TrigramIndex(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/counts"))

    def candidates(self, search: str | None) -> DataFrame | None:
        """``id, day`` of the calls that a search can find; None if any may (no three letters in a row)."""
        wanted = sorted(trigrams(search or ""))
        if not wanted:
            return None
        seen = {r.gram: r.n for r in self.counts.where(F.col("gram").isin(wanted)).collect()}
        if len(seen) < len(wanted):  # some trigram is in no id
            return self.grams.select("id", "day").where(F.lit(False))
        rarest = sorted(wanted, key=lambda g: (seen[g], g))[:LOOKED_UP]
        parts = [r[0] for r in self.grams.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, rarest))).alias("g"))
                 .select(F.pmod(F.xxhash64("g"), F.lit(PARTS)).cast("int")).distinct().collect()]
        rows = self.grams.where(F.col("part").isin(parts) & F.col("gram").isin(rarest))
        return rows.groupBy("id", "day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("id", "day")

    def restrict(self, calls: DataFrame, search: str | None) -> DataFrame:
        """The calls that a search can find, from the days that they are of."""
        found = self.candidates(search)
        if found is None:
            return calls
        if PARTITION_COLUMN in calls.columns:
            days = found.agg(F.collect_set("day").alias("days")).scalar()  # a value per day of history
            calls = calls.where(F.col(PARTITION_COLUMN).isNull() | F.array_contains(days, F.col(PARTITION_COLUMN)))
        return calls.join(found.select(F.col("id").alias("_found")), F.col("id") == F.col("_found"), "left_semi")
