"""The reference's diagnostic look-ups, re-aimed from one call id to key sets.

``unique_ids`` is ``None`` (every call), one id, a list, or a DataFrame of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.plans import lookup
from callqc.plans.facts import analysed_calls
from callqc.sources.schemas import SIGNAL_COLUMNS
from callqc.sources.tables import Tables


def conversation_status(t: Tables, unique_ids=None) -> DataFrame:
    """Both status columns of each call: the analysis's and the call log's."""
    f1 = lookup.restrict(analysed_calls(t), "unique_id", unique_ids)
    return f1.select(F.col("id").alias("analysis_id"), "review_status", "qc_status", "unique_id")


def call_signals(t: Tables, unique_ids=None) -> DataFrame:
    """Sentiment and agent signals of each analysed call, read through the join."""
    f1 = lookup.restrict(analysed_calls(t), "unique_id", unique_ids)
    return f1.select(
        F.col("id").alias("analysis_id"),
        "conversation_id",
        F.col("conversation_id").alias("log_id"),
        "unique_id",
        "agent_sender",
        *SIGNAL_COLUMNS,
    )


def call_signals_direct(t: Tables, unique_ids=None) -> DataFrame:
    """The same signals read directly from the call log (analysed or not)."""
    cl = lookup.restrict(t.calls, "unique_id", unique_ids)
    return cl.select("id", "unique_id", *SIGNAL_COLUMNS)


def completed_sample(t: Tables, status: str = "completed", n: int = 1) -> DataFrame:
    """``n`` analysed calls with the given status and their signals (lowest analysis id first)."""
    f1 = analysed_calls(t).where(F.col("review_status") == F.lit(status))
    return (
        f1.select("id", "conversation_id", "agent_sender", "unique_id", *SIGNAL_COLUMNS)
        .orderBy(F.col("id").asc_nulls_last())
        .limit(n)
    )


AUDITED_COLUMNS = SIGNAL_COLUMNS


def column_audit(df: DataFrame, expected=AUDITED_COLUMNS) -> DataFrame:
    """Which of the expected columns a table has, sorted (a schema check, no data read)."""
    present = sorted(c for c in set(expected) if c in df.columns)
    return df.sparkSession.createDataFrame([(c,) for c in present], "column_name string")
