"""The five tables as one value, and their loaders.

``Tables.conversations_log`` may carry the payload columns (``conversation_data``,
``silence_timeline``) or not; plans never read them from there.  They ask
``Tables.payloads(keys)`` instead, which returns one row per call for the requested
call ids only, so a page of 100 rows never drags the JSON payloads of the whole table
through a sort or a shuffle.  When the payloads are stored as one row per turn
(``conversation_turns``) the turns of the requested calls are filtered first and only
then folded into arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callqc.functions.filters import page_days
from callqc.sources.schemas import CONVERSATION_DATA_TYPE, PAYLOAD_COLUMNS, SILENCE_TIMELINE_TYPE
from callqc.sources.trigrams import TrigramIndex

TABLE_NAMES = (
    "conversations_log",
    "conversation_analysis",
    "conversation_review_human",
    "qc_users",
    "qc_settings",
)


@dataclass(frozen=True)
class Tables:
    conversations_log: DataFrame
    conversation_analysis: DataFrame
    conversation_review_human: DataFrame
    qc_users: DataFrame
    qc_settings: DataFrame
    # (conv_id, turn, role, text): conversation_data stored as one row per turn.
    conversation_turns: DataFrame | None = None
    # substring searches for call ids go through it where there is one (``sources.trigrams``)
    call_index: TrigramIndex | None = None

    def searched(self, unique_id: str | None) -> "Tables":
        """The tables with the calls that a search for ``unique_id`` can find."""
        if self.call_index is None or not unique_id:
            return self
        return self.with_(conversations_log=self.call_index.restrict(self.conversations_log, unique_id))

    @property
    def calls(self) -> DataFrame:
        """conversations_log without its payload columns."""
        cl = self.conversations_log
        return cl.select([c for c in cl.columns if c not in PAYLOAD_COLUMNS])

    def with_(self, **changes) -> "Tables":
        return replace(self, **changes)

    def payloads(self, keys: DataFrame | None = None, keys_are_small: bool = False) -> DataFrame:
        """(call_id, conversation_data, silence_timeline) for the calls in ``keys.call_id``.

        ``keys`` is optional; without it every call with a payload is returned.  Set
        ``keys_are_small`` only for key sets bounded by construction (a page): they are
        then broadcast, and the payload table is streamed past them without a shuffle.
        """
        cl = self.conversations_log
        has_cd = "conversation_data" in cl.columns and self.conversation_turns is None
        has_st = "silence_timeline" in cl.columns

        def restrict(df: DataFrame, key_col: str) -> DataFrame:
            if keys is None:
                return df
            k = keys.select("call_id")
            return df.join(F.broadcast(k) if keys_are_small else k, F.col(key_col) == F.col("call_id"), "left_semi")

        stored = None
        if has_cd or has_st:
            if keys is not None:
                cl = page_days(cl, keys, "call_created_at")
            stored = restrict(
                cl.select(
                    F.col("id").alias("_payload_id"),
                    (F.col("conversation_data") if has_cd else F.lit(None).cast(CONVERSATION_DATA_TYPE)).alias(
                        "conversation_data"
                    ),
                    (F.col("silence_timeline") if has_st else F.lit(None).cast(SILENCE_TIMELINE_TYPE)).alias(
                        "silence_timeline"
                    ),
                ),
                "_payload_id",
            ).withColumnRenamed("_payload_id", "call_id")
        if self.conversation_turns is None:
            if stored is None:
                # No payloads anywhere: an empty, typed relation.
                return cl.select(
                    F.col("id").alias("call_id"),
                    F.lit(None).cast(CONVERSATION_DATA_TYPE).alias("conversation_data"),
                    F.lit(None).cast(SILENCE_TIMELINE_TYPE).alias("silence_timeline"),
                ).where(F.lit(False))
            return stored

        turns = restrict(self.conversation_turns, "conv_id")
        folded = turns.groupBy(F.col("conv_id").alias("call_id")).agg(
            F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("conversation_data")
        )
        if stored is None:
            return folded.select(
                "call_id", "conversation_data", F.lit(None).cast(SILENCE_TIMELINE_TYPE).alias("silence_timeline")
            )
        return stored.drop("conversation_data").join(folded, "call_id", "full")


#: Turns in one piece of a call's payload.
CHUNK = 1000


def payload_chunks(t: Tables, keys: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """``call_id, chunk, first_turn, turns``: the turns of the calls in ``keys.call_id`` (or of all) in
    pieces of at most ``chunk`` turns, numbered from 0 in turn order.

    For calls of any number of turns: a piece holds the turns of ``chunk`` consecutive turn numbers, so
    no row and no task has to hold a whole call, and a long call is read by many tasks.  Turn
    numbers are unique within a call; pieces without turns are left out, and the numbers of the
    pieces follow the turn numbers.
    """
    if t.conversation_turns is None:
        raise ValueError("payloads are stored folded; chunks need the turns as rows")
    turns = t.conversation_turns
    if keys is not None:
        turns = turns.join(keys.select("call_id"), F.col("conv_id") == F.col("call_id"), "left_semi")
    piece = F.floor(F.col("turn") / F.lit(chunk)).cast("bigint")
    return turns.groupBy(F.col("conv_id").alias("call_id"), piece.alias("chunk")).agg(
        F.min("turn").alias("first_turn"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def load_parquet(spark: SparkSession, base: str, turns: bool = False) -> Tables:
    """Tables stored as ``{base}/{table}`` parquet directories (see ``sinks.write_tables``)."""
    read = {name: spark.read.parquet(f"{base}/{name}") for name in TABLE_NAMES}
    # parts of the stored reviews are no column of theirs
    read["conversation_review_human"] = read["conversation_review_human"].drop("review_part")
    return Tables(**read, conversation_turns=spark.read.parquet(f"{base}/conversation_turns") if turns else None)


def load_catalog(spark: SparkSession, database: str) -> Tables:
    """Tables saved in a catalog database (see ``sinks.save_bucketed_tables``)."""
    return Tables(**{name: spark.table(f"{database}.{name}") for name in TABLE_NAMES})


FACT_TABLES = ("conversations_log", "conversation_analysis", "conversation_review_human")
FETCH_ROWS = 10_000


def load_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    schema: str = "call",
    partitions: dict[str, tuple[str, str, str, int]] | None = None,
    predicates: dict[str, list[str]] | None = None,
) -> Tables:
    """Read the five tables from a database over JDBC.

    Large tables are read by many tasks in parallel, either by ``partitions`` (table ->
    ``(column, lower, upper, num_partitions)``, a numeric, date or timestamp column such
    as ``created_at``) or by ``predicates`` (table -> one WHERE clause per task, e.g. one
    day each; useful because the ids are text).  Credentials travel in ``properties``
    and are never stored by this library.  Rows come in fetches of ``FETCH_ROWS`` unless
    ``properties`` names another ``fetchsize`` (some drivers buffer a whole result without
    one).  The fact tables must be split one way or the other: one task would read them all.
    """
    properties = {"fetchsize": str(FETCH_ROWS)} | properties
    missing = [name for name in FACT_TABLES if name not in (partitions or {}) and name not in (predicates or {})]
    if missing:
        raise ValueError(f"give partitions or predicates for {', '.join(missing)}")
    partitions = partitions or {}
    predicates = predicates or {}
    frames = {}
    for name in TABLE_NAMES:
        table = f"{schema}.{name}"
        if name in predicates:
            frames[name] = spark.read.jdbc(url, table, predicates=predicates[name], properties=properties)
            continue
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
        for k, v in properties.items():
            reader = reader.option(k, v)
        if name in partitions:
            column, lower, upper, n = partitions[name]
            reader = (
                reader.option("partitionColumn", column)
                .option("lowerBound", lower)
                .option("upperBound", upper)
                .option("numPartitions", str(n))
            )
        frames[name] = reader.load()
    return Tables(**frames)
