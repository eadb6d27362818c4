"""Hand-written tables for unit tests (bigint keys, every column explicit or defaulted)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from callqc.sources import schemas
from callqc.sources.tables import Tables

K = T.LongType()


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def frame(spark, schema: T.StructType, rows: list[dict]):
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def call(id, created_at, **kw):
    base = dict(id=id, created_at=ts(created_at), unique_id=f"CALL{id:08d}", agent_sender="1001", is_analyzed=True,
                qc_status="pending", total_duration_seconds=100, total_silence_seconds=10,
                longest_silence_gap_seconds=2.5, silence_percentage=5.0)
    base.update(kw)
    return base


def analysis(id, conversation_id, created_at, **kw):
    base = dict(id=id, conversation_id=conversation_id, created_at=ts(created_at), opening_score=1.0,
                listening_score=2.0, empathy_score=3.0, response_process_score=4.0, system_updation_score=1.0,
                closing_score=2.0, total_weighted_score=100.0, final_percentage_score=50.0,
                conversation_score_ai=60.0, process_score_human=None, other_criteria_score_human=None,
                final_score_combined=70.0, customer_sentiment_label="positive", customer_sentiment_start="negative",
                customer_sentiment_end="positive", main_topic="billing", strengths="s", areas_for_improvement="a",
                review_status="pending_review",
                weights_snapshot='{"opening":2,"listening":12,"empathy":10,"response_process":15,"system_updation":12,"closing":4}')
    base.update(kw)
    return base


def review(id, analysis_id, reviewer_id=1, **kw):
    base = dict(id=id, analysis_id=analysis_id, reviewer_id=reviewer_id, opening_score_override=2.0,
                total_weighted_score_human=10.0, final_percentage_score_human=20.0,
                other_criteria_weighted_score_human=30.0, other_criteria_percentage_score_human=40.0,
                weights_snapshot="{}", max_possible_overall_score=220.0)
    base.update(kw)
    return base


def user(id, username, created_at="2023-12-01 00:00:00", **kw):
    base = dict(id=id, username=username, full_name=f"User {id}", role="agent", is_active=True,
                created_at=ts(created_at))
    base.update(kw)
    return base


DEFAULT_SETTINGS = [
    dict(setting_key="weights",
         setting_value='{"opening":2,"listening":12,"empathy":10,"responseProcess":16,"closing":4}'),
    dict(setting_key="max_score_per_metric", setting_value="4"),
]


def tables(spark, calls=(), analyses=(), reviews=(), users=(), settings=None) -> Tables:
    return Tables(
        conversations_log=frame(spark, schemas.conversations_log(K), list(calls)),
        conversation_analysis=frame(spark, schemas.conversation_analysis(K), list(analyses)),
        conversation_review_human=frame(spark, schemas.conversation_review_human(K), list(reviews)),
        qc_users=frame(spark, schemas.qc_users(K), list(users)),
        qc_settings=frame(spark, schemas.qc_settings(), list(DEFAULT_SETTINGS if settings is None else settings)),
    )
