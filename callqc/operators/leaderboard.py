"""Agent leaderboard and the agent list.

Per-agent aggregation is partial-then-final (an agent with a third of all calls is a
single partial row per task before the shuffle).  Ranking numbers the aggregated agents within
buckets of whole score points (``global_row_number``) rather than in a window without
PARTITION BY, so no task ever holds every agent, and no job runs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.functions.filters import ALL_RANGES, analysis_date_filter, where_all
from callqc.plans.facts import windowed_calls
from callqc.plans.ranking import global_row_number
from callqc.sources.tables import Tables

AVERAGES = (
    ("final_percentage_score", "average_score"),
    ("opening_score", "average_opening_score"),
    ("listening_score", "average_listening_score"),
    ("empathy_score", "average_empathy_score"),
    ("response_process_score", "average_response_score"),
    ("closing_score", "average_closing_score"),
)


def leaderboard(t: Tables, date_range=None, start_date=None, end_date=None, as_of=None) -> DataFrame:
    """Agents ranked by average final score (NULL averages first, ties by agent)."""
    window = analysis_date_filter(t.conversation_analysis, date_range, start_date, end_date, as_of, ALL_RANGES)
    f1 = where_all(windowed_calls(t, window), F.col("agent_sender").isNotNull())
    agg = (
        f1.groupBy(F.col("agent_sender").alias("agent_extension"))
        .agg(
            F.expr("count(1) AS total_conversations"),
            *[F.expr(f"avg({src}) AS {dst}") for src, dst in AVERAGES],
            F.expr("avg(silence_percentage) AS average_silence_percent"),
            F.expr("CAST(sum(CASE WHEN customer_sentiment_end = 'positive' THEN 1 ELSE 0 END) AS BIGINT) AS _end_positive"),
            F.expr("CAST(sum(CASE WHEN customer_sentiment_start = 'negative' THEN 1 ELSE 0 END) AS BIGINT)"
                   " AS _start_negative"),
        )
        .where(F.col("total_conversations") > 0)
    )
    return ranked(agg)


def ranked(agg: DataFrame) -> DataFrame:
    """The leaderboard of aggregated agents: ranks by average score, empty averages as 0."""
    order = [F.col("average_score").desc_nulls_first(), F.col("agent_extension").asc_nulls_last()]
    # Buckets of whole score points, on whatever scale the scores are.
    point = F.expr("CAST(floor(average_score) AS BIGINT)")
    numbered = global_row_number(agg, order, point, F.col("_b").desc_nulls_first()).orderBy(*order)
    return numbered.selectExpr(
        "CAST(rank AS INT) AS rank",
        "agent_extension",
        "coalesce(total_conversations, 0L) AS total_conversations",
        *[f"coalesce({dst}, 0D) AS {dst}" for _, dst in AVERAGES],
        # guarded: with ANSI mode a zero divisor raises instead of returning NULL
        "CASE WHEN _start_negative > 0 THEN CAST(_end_positive AS DOUBLE) / CAST(_start_negative AS DOUBLE) * 100D"
        " ELSE 0D END AS sentiment_improvement_percent",
        "coalesce(average_silence_percent, 0D) AS average_silence_percent",
    )


def agents_list(t: Tables) -> DataFrame:
    """Distinct non-null agents with at least one analysed call, ascending.

    The join only tests existence, so it is a left semi join: the analysis side
    contributes one key column and no row multiplication, and the distinct runs with a
    partial aggregate before its shuffle.
    """
    calls = t.calls.where(F.col("agent_sender").isNotNull())
    analysed = t.conversation_analysis.select(F.col("conversation_id").alias("_cid"))
    return (
        calls.join(analysed, F.col("id") == F.col("_cid"), "left_semi")
        .select(F.col("agent_sender").cast("string").alias("agent_sender"))
        .distinct()
        .orderBy(F.col("agent_sender").asc_nulls_last())
    )


def agents_total(t: Tables) -> DataFrame:
    return agents_list(t).agg(F.count(F.lit(1)).alias("total"))
