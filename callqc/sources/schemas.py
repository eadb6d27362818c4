"""Declared schemas of the five tables and the change feeds.

Ids are text (UUIDs) in a production database; the operators never depend on the key
type, and the derived test tables use bigint keys, so the key type is a parameter.
"""

from __future__ import annotations

from pyspark.sql import types as T

CONVERSATION_DATA_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("turn", T.LongType()),
            T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )
)
SILENCE_TIMELINE_TYPE = T.ArrayType(
    T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
)

# Columns of conversations_log that hold per-call payloads.  They are never filtered,
# grouped or sorted on, so plans attach them after the rows are chosen.
PAYLOAD_COLUMNS = ("conversation_data", "silence_timeline")

SIGNAL_COLUMNS = ("user_sentiment_overall", "agent_tone", "agent_energy", "agent_clarity", "agent_patience")

CRITERIA = ("opening", "listening", "empathy", "response_process", "system_updation", "closing")

HUMAN_SCORE_COLUMNS = (
    "total_weighted_score_human",
    "final_percentage_score_human",
    "other_criteria_weighted_score_human",
    "other_criteria_percentage_score_human",
)

REVIEW_VALUE_COLUMNS = (
    tuple(f"{c}_score_override" for c in CRITERIA)
    + tuple(f"{c}_justification_override" for c in CRITERIA)
    + ("strengths_override", "areas_for_improvement_override")
    + HUMAN_SCORE_COLUMNS
)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


def conversations_log(key=T.StringType()) -> T.StructType:
    return T.StructType(
        [
            _f("id", key, False),
            _f("created_at", T.TimestampNTZType()),
            _f("unique_id", T.StringType()),
            _f("agent_sender", T.StringType()),
            _f("is_analyzed", T.BooleanType()),
            _f("qc_status", T.StringType()),
            _f("conversation_data", CONVERSATION_DATA_TYPE),
            _f("total_duration_seconds", T.LongType()),
            _f("total_silence_seconds", T.LongType()),
            _f("longest_silence_gap_seconds", T.DoubleType()),
            _f("silence_percentage", T.DoubleType()),
            _f("silence_timeline", SILENCE_TIMELINE_TYPE),
        ]
        + [_f(c, T.StringType()) for c in SIGNAL_COLUMNS]
    )


def conversation_analysis(key=T.StringType()) -> T.StructType:
    scores = [_f(f"{c}_score", T.DoubleType()) for c in CRITERIA]
    doubles = [
        _f(c, T.DoubleType())
        for c in (
            "total_weighted_score",
            "final_percentage_score",
            "conversation_score_ai",
            "process_score_human",
            "other_criteria_score_human",
            "final_score_combined",
        )
    ]
    texts = [
        _f(c, T.StringType())
        for c in (
            "customer_sentiment_label",
            "customer_sentiment_start",
            "customer_sentiment_end",
            "main_topic",
            "strengths",
            "areas_for_improvement",
            "review_status",
            "weights_snapshot",
        )
    ]
    return T.StructType(
        [_f("id", key, False), _f("conversation_id", key), _f("created_at", T.TimestampNTZType())]
        + scores
        + doubles
        + texts
    )


def conversation_review_human(key=T.StringType()) -> T.StructType:
    fields = [_f("id", key, False), _f("analysis_id", key), _f("reviewer_id", key)]
    for name in REVIEW_VALUE_COLUMNS:
        dtype = T.DoubleType() if name.endswith("_score_override") or name in HUMAN_SCORE_COLUMNS else T.StringType()
        fields.append(_f(name, dtype))
    fields += [_f("weights_snapshot", T.StringType()), _f("max_possible_overall_score", T.DoubleType())]
    return T.StructType(fields)


def qc_users(key=T.StringType()) -> T.StructType:
    return T.StructType(
        [
            _f("id", key, False),
            _f("username", T.StringType(), False),
            _f("full_name", T.StringType()),
            _f("role", T.StringType()),
            _f("is_active", T.BooleanType()),
            _f("created_at", T.TimestampNTZType()),
        ]
    )


def qc_settings() -> T.StructType:
    return T.StructType(
        [
            _f("setting_key", T.StringType(), False),
            _f("setting_value", T.StringType()),
            _f("updated_at", T.TimestampNTZType()),
            _f("updated_by", T.StringType()),
        ]
    )


def review_submissions(key=T.StringType()) -> T.StructType:
    crh = conversation_review_human(key)
    keep = [f for f in crh.fields if f.name not in ("id", "weights_snapshot", "max_possible_overall_score")]
    return T.StructType([_f("seq", T.LongType(), False)] + keep)


def user_changes(key=T.StringType()) -> T.StructType:
    return T.StructType(
        [
            _f("seq", T.LongType(), False),
            _f("op", T.StringType(), False),
            _f("id", key),
            _f("username", T.StringType()),
            _f("full_name", T.StringType()),
            _f("role", T.StringType()),
            _f("is_active", T.BooleanType()),
        ]
    )


def setting_changes() -> T.StructType:
    return T.StructType(
        [
            _f("seq", T.LongType(), False),
            _f("setting_key", T.StringType(), False),
            _f("setting_value", T.StringType()),
            _f("updated_by", T.StringType()),
            _f("updated_at", T.TimestampNTZType()),
        ]
    )
