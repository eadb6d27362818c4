"""Dashboard panels from mergeable daily summaries.

One pass over the joined facts adds up sums and counts per day, agent and review status, and counts per
day, agent and topic (grouping sets of the same aggregate, so the facts are joined once for all
panels).  Sums and counts merge: summaries of new days are added, and a change of rows is the
summary of the new rows less that of the old ones.  Every panel is then a small aggregate over
summaries, whose size follows days, agents and topics and not the calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.functions.filters import ALL_RANGES, NO_YESTERDAY, TREND_RANGES, agent_filter, date_range_filter, status_filter, where_all
from callqc.operators.dashboard import SENTIMENT_LABELS, kpi_columns
from callqc.operators.leaderboard import AVERAGES, ranked
from callqc.plans.facts import analysed_calls
from callqc.sources.schemas import CRITERIA
from callqc.sources.tables import Tables

KEYS = ("day", "agent_sender", "review_status", "main_topic")
#: Which of the two summaries a row is of.
DAILY, TOPICS = 0, 1
_AVERAGED = ("final_percentage_score", "conversation_score_ai", "process_score_human", "other_criteria_score_human", "final_score_combined",
             *(f"{c}_score" for c in CRITERIA), "silence_percentage", "longest_silence_gap_seconds", "total_silence_seconds")
_COUNTED = {
    **{f"label_{x}": f"customer_sentiment_label = '{x}'" for x in SENTIMENT_LABELS},
    **{f"{when}_{x}": f"customer_sentiment_{when} = '{x}'" for when in ("start", "end") for x in ("positive", "negative")},
}
MEASURES = ("calls", *(f"{kind}_{c}" for c in _AVERAGED for kind in ("sum", "n")), *_COUNTED)


def summarise(f1: DataFrame, sign: int = 1) -> DataFrame:
    """``kind``, the keys and the measures of joined analyses and calls (``facts.analysed_calls``).

    ``sign`` -1 takes the rows away when merged.  Keys that a summary does not have are null.
    """
    rows = f1.select(F.to_date("created_at").alias("day"), *(c for c in KEYS if c != "day"), *_AVERAGED,
                     *(F.expr(f"CAST(coalesce({p}, false) AS INT) AS {name}") for name, p in _COUNTED.items()))
    added = [F.sum(F.lit(sign)).alias("calls")]
    for c in _AVERAGED:
        added += [F.coalesce(F.sum(F.col(c).cast("double")) * sign, F.lit(0.0)).alias(f"sum_{c}"), (F.count(c) * sign).alias(f"n_{c}")]
    added += [(F.sum(c) * sign).alias(c) for c in _COUNTED]
    sets = rows.groupingSets([["day", "agent_sender", "review_status"], ["day", "agent_sender", "main_topic"]], *KEYS)
    kind = F.grouping("main_topic")  # 1 where the topic is no key
    return sets.agg(F.when(kind == 1, DAILY).otherwise(TOPICS).alias("kind"), *added).select("kind", *KEYS, *MEASURES).where(
        (F.col("kind") == DAILY) | F.col("main_topic").isNotNull())


def merge(*summaries: DataFrame) -> DataFrame:
    """The summary of all rows that the given summaries are of."""
    every = reduce(DataFrame.unionByName, summaries)
    return every.groupBy("kind", *KEYS).agg(*(F.sum(c).alias(c) for c in MEASURES)).where("calls <> 0")


def status_change(t: Tables, analyses: DataFrame) -> DataFrame:
    """What a change of review statuses (``merges.status_changes``: ``id, review_status``) does to the
    summary of ``t``: merge it to get the summary after the change."""
    rows = analysed_calls(t).join(analyses.select("id", F.col("review_status").alias("_status")), "id")
    return merge(summarise(rows, -1), summarise(rows.withColumn("review_status", F.col("_status"))))


def _daily(summary: DataFrame, agent_id, date_range, start_date, end_date, as_of, allowed, kind: int = DAILY) -> DataFrame:
    # day ranges begin and end at midnight, so they select whole summaries
    return where_all(summary.where(F.col("kind") == kind), agent_filter(agent_id), date_range_filter("day", date_range, start_date, end_date, as_of, allowed))


def _average(column: str, name: str):
    return F.expr(f"sum(sum_{column}) / nullif(sum(n_{column}), 0) AS {name}")


def _count(column: str, name: str):
    return F.expr(f"CAST(sum({column}) AS BIGINT) AS {name}")


def kpis(summary: DataFrame, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None) -> DataFrame:
    """``dashboard.kpis`` from a summary."""
    rows = _daily(summary, agent_id, date_range, start_date, end_date, as_of, ALL_RANGES)
    return rows.agg(
        _average("final_percentage_score", "average_score"), _average("conversation_score_ai", "average_conversation_score_ai"),
        _average("process_score_human", "average_process_score_human"), _average("other_criteria_score_human", "average_other_criteria_score_human"),
        _average("final_score_combined", "average_final_score_combined"), _average("silence_percentage", "average_silence_percentage"),
        _average("longest_silence_gap_seconds", "average_longest_silence"), F.expr("sum(sum_total_silence_seconds) AS total_silence_seconds"),
        _count("calls", "total_conversations"), _count("label_positive", "positive_sentiment"), _count("label_negative", "negative_sentiment"),
        *(_count(f"{when}_{x}", f"{when}_sentiment_{x}") for when in ("start", "end") for x in ("positive", "negative")),
    ).selectExpr(*kpi_columns())


def score_trends(summary: DataFrame, agent_id=None, date_range="last7days", start_date=None, end_date=None, as_of=None) -> DataFrame:
    """``dashboard.score_trends`` from a summary."""
    rows = _daily(summary, agent_id, date_range, start_date, end_date, as_of, TREND_RANGES)
    return rows.groupBy(F.col("day").alias("date")).agg(
        _average("final_percentage_score", "average_score"), _average("conversation_score_ai", "average_ai_score"),
        _average("final_score_combined", "average_combined_score"), _count("calls", "conversation_count"),
    ).orderBy(F.col("date").asc_nulls_last())


def _criteria(rows: DataFrame, criteria) -> DataFrame:
    raw = rows.agg(*(_average(f"{c}_score", f"average_{c}") for c in criteria))
    return raw.selectExpr(*(f"coalesce({c}, 0D) AS {c}" for c in raw.columns))


def criteria_scores(summary: DataFrame, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None) -> DataFrame:
    """``dashboard.criteria_scores`` from a summary."""
    return _criteria(_daily(summary, agent_id, date_range, start_date, end_date, as_of, NO_YESTERDAY), ("opening", "listening", "empathy", "closing"))


def human_criteria_scores(summary: DataFrame, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None,
                          status="review_completed") -> DataFrame:
    """``dashboard.human_criteria_scores`` from a summary."""
    rows = where_all(_daily(summary, agent_id, date_range, start_date, end_date, as_of, NO_YESTERDAY), status_filter(status))
    return _criteria(rows, ("response_process", "system_updation"))


def sentiment_distribution(summary: DataFrame, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None) -> DataFrame:
    """``dashboard.sentiment_distribution`` from a summary."""
    rows = _daily(summary, agent_id, date_range, start_date, end_date, as_of, NO_YESTERDAY)
    return rows.agg(*(_count(f"label_{x}", x) for x in SENTIMENT_LABELS)).selectExpr(*(f"coalesce({x}, 0L) AS {x}" for x in SENTIMENT_LABELS))


def top_topics(summary: DataFrame, agent_id=None, date_range=None, start_date=None, end_date=None, as_of=None, limit=10) -> DataFrame:
    """``dashboard.top_topics`` from a summary."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    rows = _daily(summary, agent_id, date_range, start_date, end_date, as_of, NO_YESTERDAY, TOPICS).where("main_topic <> ''")
    return (rows.groupBy("main_topic").agg(_count("calls", "count"))
            .orderBy(F.col("count").desc_nulls_first(), F.col("main_topic").asc_nulls_last()).limit(limit))


def leaderboard(summary: DataFrame, date_range=None, start_date=None, end_date=None, as_of=None) -> DataFrame:
    """``leaderboard.leaderboard`` from a summary."""
    rows = _daily(summary, None, date_range, start_date, end_date, as_of, ALL_RANGES).where("agent_sender IS NOT NULL")
    return ranked(rows.groupBy(F.col("agent_sender").alias("agent_extension")).agg(
        _count("calls", "total_conversations"), *(_average(src, dst) for src, dst in AVERAGES), _average("silence_percentage", "average_silence_percent"),
        _count("end_positive", "_end_positive"), _count("start_negative", "_start_negative")).where("total_conversations > 0"))
