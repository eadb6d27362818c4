"""Dashboard panels over F1 (analyses joined to their calls).

Each panel is one aggregate over the filtered join.  Global panels (KPIs, criteria,
sentiment) are a single ``agg``: per-task partial aggregates, one tiny shuffle, one row.
Grouped panels (daily trends, topics) aggregate partially before the shuffle, so a day
or topic holding a large share of the calls costs no more than any other group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callqc.functions.filters import (
    ALL_RANGES,
    NO_YESTERDAY,
    TREND_RANGES,
    agent_filter,
    analysis_date_filter,
    date_range_filter,
    status_filter,
    where_all,
)
from callqc.functions.scoring import count_if
from callqc.plans.facts import windowed_calls
from callqc.sources.tables import Tables


def filtered_calls(t: Tables, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None,
                   allowed=ALL_RANGES, extra=()) -> DataFrame:
    """F1 within the day range; ``extra`` are further predicates on analysis columns."""
    window = analysis_date_filter(t.conversation_analysis, date_range, start_date, end_date, as_of, allowed)
    return where_all(windowed_calls(t, window, *extra), agent_filter(agent_id))


def _zero(c, dtype="double"):
    return F.coalesce(c, F.lit(0).cast(dtype))


_KPI_DOUBLES = (
    "average_score",
    "average_conversation_score_ai",
    "average_process_score_human",
    "average_other_criteria_score_human",
    "average_final_score_combined",
)
_KPI_COUNTS = ("total_conversations", "positive_sentiment", "negative_sentiment")
_KPI_SILENCE = ("average_silence_percentage", "average_longest_silence")
_KPI_ENDS = ("start_sentiment_positive", "start_sentiment_negative", "end_sentiment_positive", "end_sentiment_negative")


def kpi_columns() -> list[str]:
    """Final KPI projection (SQL text: one JVM call for the whole list)."""
    return [
        *[f"coalesce({c}, 0D) AS {c}" for c in _KPI_DOUBLES],
        *[f"coalesce({c}, 0L) AS {c}" for c in _KPI_COUNTS],
        *[f"coalesce({c}, 0D) AS {c}" for c in _KPI_SILENCE],
        "coalesce(CAST(total_silence_seconds AS DOUBLE), 0D) AS total_silence_seconds",
        *[f"coalesce({c}, 0L) AS {c}" for c in _KPI_ENDS],
        # guarded: with ANSI mode a zero divisor raises instead of returning NULL
        "CASE WHEN coalesce(start_sentiment_negative, 0L) > 0 "
        "THEN CAST(end_sentiment_positive AS DOUBLE) / CAST(start_sentiment_negative AS DOUBLE) * 100D "
        "ELSE 0D END AS sentiment_improvement",
    ]


def kpis(t: Tables, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None) -> DataFrame:
    """One row of 16 KPIs; every NULL aggregate reads as 0."""
    f1 = filtered_calls(t, agent_id, date_range, start_date, end_date, as_of, ALL_RANGES)
    return f1.agg(*_kpi_aggregates("TRUE")).selectExpr(*kpi_columns())


def score_trends(t: Tables, agent_id=None, date_range="last7days", start_date=None, end_date=None, as_of=None) -> DataFrame:
    """Per calendar day of the analysis: three averages and the count, oldest day first."""
    f1 = filtered_calls(t, agent_id, date_range, start_date, end_date, as_of, TREND_RANGES)
    return (
        f1.groupBy(F.to_date("created_at").alias("date"))
        .agg(
            F.avg("final_percentage_score").alias("average_score"),
            F.avg("conversation_score_ai").alias("average_ai_score"),
            F.avg("final_score_combined").alias("average_combined_score"),
            F.count(F.lit(1)).alias("conversation_count"),
        )
        .orderBy(F.col("date").asc_nulls_last())
    )


def criteria_scores(t: Tables, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None) -> DataFrame:
    f1 = filtered_calls(t, agent_id, date_range, start_date, end_date, as_of, NO_YESTERDAY)
    raw = f1.agg(*[F.avg(f"{c}_score").alias(f"average_{c}") for c in ("opening", "listening", "empathy", "closing")])
    return raw.select(*[_zero(F.col(c)).alias(c) for c in raw.columns])


def human_criteria_scores(t: Tables, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None,
                          status="review_completed") -> DataFrame:
    f1 = filtered_calls(t, agent_id, date_range, start_date, end_date, as_of, NO_YESTERDAY,
                        extra=(status_filter(status),))
    raw = f1.agg(
        F.avg("response_process_score").alias("average_response_process"),
        F.avg("system_updation_score").alias("average_system_updation"),
    )
    return raw.select(*[_zero(F.col(c)).alias(c) for c in raw.columns])


SENTIMENT_LABELS = ("positive", "negative", "neutral")


def sentiment_distribution(t: Tables, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None) -> DataFrame:
    """Counts of the three labels as one row; other labels and NULL are not shown."""
    f1 = filtered_calls(t, agent_id, date_range, start_date, end_date, as_of, NO_YESTERDAY)
    raw = f1.agg(*[count_if(F.col("customer_sentiment_label") == s).alias(s) for s in SENTIMENT_LABELS])
    return raw.select(*[_zero(F.col(s), "bigint").alias(s) for s in SENTIMENT_LABELS])


def top_topics(t: Tables, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None, limit=10) -> DataFrame:
    """Most frequent non-empty topics (ties by topic), ``limit`` in 1..50."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    f1 = filtered_calls(t, agent_id, date_range, start_date, end_date, as_of, NO_YESTERDAY,
                        extra=(F.col("main_topic").isNotNull(), F.col("main_topic") != ""))
    return (
        f1.groupBy("main_topic")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc_nulls_first(), F.col("main_topic").asc_nulls_last())
        .limit(limit)
    )


def _kpi_aggregates(on: str) -> list[Column]:
    """The KPI aggregates over the rows where the SQL predicate ``on`` holds."""
    def avg(c, name):
        return F.expr(f"avg(CASE WHEN {on} THEN {c} END) AS {name}")

    def cnt(cond, name):
        return F.expr(f"CAST(sum(CASE WHEN {on} AND {cond} THEN 1 ELSE 0 END) AS BIGINT) AS {name}")

    return [
        avg("final_percentage_score", "average_score"),
        avg("conversation_score_ai", "average_conversation_score_ai"),
        avg("process_score_human", "average_process_score_human"),
        avg("other_criteria_score_human", "average_other_criteria_score_human"),
        avg("final_score_combined", "average_final_score_combined"),
        cnt("TRUE", "total_conversations"),
        cnt("customer_sentiment_label = 'positive'", "positive_sentiment"),
        cnt("customer_sentiment_label = 'negative'", "negative_sentiment"),
        avg("silence_percentage", "average_silence_percentage"),
        avg("longest_silence_gap_seconds", "average_longest_silence"),
        F.expr(f"sum(CASE WHEN {on} THEN total_silence_seconds END) AS total_silence_seconds"),
        cnt("customer_sentiment_start = 'positive'", "start_sentiment_positive"),
        cnt("customer_sentiment_start = 'negative'", "start_sentiment_negative"),
        cnt("customer_sentiment_end = 'positive'", "end_sentiment_positive"),
        cnt("customer_sentiment_end = 'negative'", "end_sentiment_negative"),
    ]


def overview(t: Tables, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None,
             status="review_completed") -> DataFrame:
    """KPIs, criteria, human criteria and sentiment panels from one scan and one aggregate.

    Each panel keeps its own day-range rules (only the KPIs have "yesterday"),
    applied per aggregate with conditional aggregation; the rows read are those any
    panel needs.  Same values as ``kpis`` + ``criteria_scores`` +
    ``human_criteria_scores`` + ``sentiment_distribution`` with the same arguments.
    """
    ca = t.conversation_analysis
    d_all = analysis_date_filter(ca, date_range, start_date, end_date, as_of, ALL_RANGES)
    d_noy = analysis_date_filter(ca, date_range, start_date, end_date, as_of, NO_YESTERDAY)
    either = None if d_all is None or d_noy is None else (d_all | d_noy)
    rows = where_all(windowed_calls(t, either), agent_filter(agent_id))
    # on the joined rows the time alone decides
    d_all = date_range_filter("created_at", date_range, start_date, end_date, as_of, ALL_RANGES)
    d_noy = date_range_filter("created_at", date_range, start_date, end_date, as_of, NO_YESTERDAY)
    in_all = d_all if d_all is not None else F.lit(True)
    in_noy = d_noy if d_noy is not None else F.lit(True)
    flagged = rows.withColumns(
        {"_in_all": in_all, "_in_noy": in_noy, "_in_human": in_noy & (F.col("review_status") == F.lit(status))}
    )
    raw = flagged.agg(
        *_kpi_aggregates("_in_all"),
        *[F.expr(f"avg(CASE WHEN _in_noy THEN {c}_score END) AS average_{c}")
          for c in ("opening", "listening", "empathy", "closing")],
        F.expr("avg(CASE WHEN _in_human THEN response_process_score END) AS average_response_process"),
        F.expr("avg(CASE WHEN _in_human THEN system_updation_score END) AS average_system_updation"),
        *[F.expr(f"CAST(sum(CASE WHEN _in_noy AND customer_sentiment_label = '{s_}' THEN 1 ELSE 0 END) AS BIGINT)"
                 f" AS {s_}") for s_ in SENTIMENT_LABELS],
    )
    panels = [f"coalesce({c}, 0D) AS {c}" for c in
              ("average_opening", "average_listening", "average_empathy", "average_closing",
               "average_response_process", "average_system_updation")]
    return raw.selectExpr(*kpi_columns(), *panels, *[f"coalesce({s_}, 0L) AS {s_}" for s_ in SENTIMENT_LABELS])
