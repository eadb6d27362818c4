"""Writing the tables in a layout the plans can prune.

The two fact tables are written partitioned by the calendar day of ``created_at``
(``created_date``), so a date-range predicate on ``created_at`` also prunes whole
directories (``filters.analysis_date_filter``).  Analyses also carry their call's day, so the
same range prunes the call log to the days those analyses belong to (``filters.call_days``).
Payload columns stay in the call table; they are only read for the rows a plan keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callqc.functions.filters import CALL_DAY
from callqc.sources.tables import TABLE_NAMES, Tables

PARTITIONED = {"conversations_log": "created_at", "conversation_analysis": "created_at"}

#: Reviews have no time: they are stored in parts by a hash of their analysis, so an update
#: (``updates.rewrite_parts``) touches the parts of the analyses reviewed.
REVIEW_PART, REVIEW_PARTS = "review_part", 256


def review_part(analysis_id: Column) -> Column:
    return F.pmod(F.xxhash64(analysis_id.cast("string")), F.lit(REVIEW_PARTS)).cast("int")


def with_date_partition(df: DataFrame, column: str = "created_at") -> DataFrame:
    return df.withColumn("created_date", F.to_date(F.col(column)))


def with_call_day(analyses: DataFrame, calls: DataFrame) -> DataFrame:
    """Analyses with ``call_date``, the day of their call (null without a call or a time), by which a
    day range on the analyses also names the days of the call log to read."""
    days = calls.select(F.col("id").alias("conversation_id"), F.to_date("created_at").alias(CALL_DAY))
    return analyses.drop(CALL_DAY).join(days, "conversation_id", "left").select(*[c for c in analyses.columns if c != CALL_DAY], CALL_DAY)


def write_table(df: DataFrame, path: str, name: str, mode: str = "errorifexists") -> None:
    writer = df
    if name in PARTITIONED:
        # rows of a day meet before the write, and large days are split by their size, so a day
        # gets as few files as its bytes need instead of one from every task
        writer = with_date_partition(df, PARTITIONED[name]).hint("rebalance", "created_date")
        writer.write.mode(mode).partitionBy("created_date").parquet(f"{path}/{name}")
    elif name == "conversation_review_human":
        parts = df.withColumn(REVIEW_PART, review_part(F.col("analysis_id"))).hint("rebalance", REVIEW_PART)
        parts.write.mode(mode).partitionBy(REVIEW_PART).parquet(f"{path}/{name}")
    else:
        writer.write.mode(mode).parquet(f"{path}/{name}")


def write_tables(t: Tables, path: str, mode: str = "errorifexists", turns_as_rows: bool = False) -> None:
    """Write all five tables under ``path``.

    By default the call payloads are folded into ``conversations_log``; with
    ``turns_as_rows`` (and turn rows available) they are written as a separate
    ``conversation_turns`` table (``load_parquet(..., turns=True)``), so a page folds the
    turns of its own calls only.  Write a new version to a new path; never overwrite the
    tables a plan is reading.
    """
    frames = {name: getattr(t, name) for name in TABLE_NAMES} | {"conversation_analysis": with_call_day(t.conversation_analysis, t.calls)}
    if turns_as_rows and t.conversation_turns is not None:
        frames["conversations_log"] = t.conversations_log.drop("conversation_data")
        t.conversation_turns.write.mode(mode).parquet(f"{path}/conversation_turns")
    elif t.conversation_turns is not None or "conversation_data" not in frames["conversations_log"].columns:
        payloads = t.payloads().withColumnRenamed("call_id", "_pid")
        cl = t.calls.join(payloads, F.col("id") == F.col("_pid"), "left").drop("_pid")
        frames["conversations_log"] = cl
    for name, df in frames.items():
        write_table(df, path, name, mode)


# Bucket keys that co-locate the analysis ⋈ call join (F1): both sides hashed on the call id.
BUCKET_KEYS = {"conversations_log": "id", "conversation_analysis": "conversation_id",
               "conversation_review_human": "analysis_id"}


def save_bucketed_tables(t: Tables, database: str, buckets: int, mode: str = "errorifexists") -> None:
    """Save the tables into a catalog database, facts bucketed for shuffle-free F1 joins.

    ``conversations_log`` (by ``id``) and ``conversation_analysis`` (by
    ``conversation_id``) get the same bucket count, so the join on the call id reads
    matching buckets side by side without an exchange; both stay partitioned by day.
    Choose ``buckets`` so a bucket of one day is a few hundred MB.
    """
    spark = t.conversation_analysis.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    frames = {name: getattr(t, name) for name in TABLE_NAMES} | {"conversation_analysis": with_call_day(t.conversation_analysis, t.calls)}
    if t.conversation_turns is not None or "conversation_data" not in frames["conversations_log"].columns:
        payloads = t.payloads().withColumnRenamed("call_id", "_pid")
        frames["conversations_log"] = t.calls.join(payloads, F.col("id") == F.col("_pid"), "left").drop("_pid")
    for name, df in frames.items():
        writer = df
        if name in PARTITIONED:
            writer = with_date_partition(df, PARTITIONED[name])
        if name in BUCKET_KEYS:  # a task holds whole buckets: one file per bucket and day
            writer = writer.repartition(buckets, BUCKET_KEYS[name])
        w = writer.write.mode(mode)
        if name in PARTITIONED:
            w = w.partitionBy("created_date")
        if name in BUCKET_KEYS:
            w = w.bucketBy(buckets, BUCKET_KEYS[name]).sortBy(BUCKET_KEYS[name])
        w.saveAsTable(f"{database}.{name}")
