"""Operators on hand-written rows: NULL orders, empty inputs, fan-out, payloads, defaults."""

import pytest
from pyspark.sql import functions as F

from callqc.operators import comparison, conversations, dashboard, leaderboard, reviews, scripts, settings, users
from tests.helpers import analysis, call, review, tables, user

TL = [{"start": 1.0, "end": 2.5}]
TURNS = [{"turn": 0, "role": "user", "text": "hi"}, {"turn": 1, "role": "agent", "text": "hello"}]


@pytest.fixture(scope="module")
def t(spark):
    calls = [
        call(1, "2024-01-10 09:00:00", agent_sender="1001", conversation_data=TURNS, silence_timeline=TL),
        call(2, "2024-01-11 09:00:00", agent_sender="1001", silence_percentage=None),
        call(3, "2024-01-12 09:00:00", agent_sender="1002"),
        call(4, "2024-01-12 09:00:00", agent_sender=None),
        call(5, "2024-01-13 09:00:00", agent_sender="1003", is_analyzed=False),
        call(6, "2024-01-14 09:00:00", agent_sender="1003", is_analyzed=None),
    ]
    analyses = [
        analysis(11, 1, "2024-01-10 11:00:00", final_percentage_score=80.0, review_status="completed",
                 customer_sentiment_label="positive", main_topic="billing"),
        analysis(12, 2, "2024-01-11 23:30:00", final_percentage_score=60.0, opening_score=None,
                 customer_sentiment_label="mixed", customer_sentiment_start="positive", main_topic=""),
        analysis(13, 3, "2024-01-12 11:00:00", final_percentage_score=None, customer_sentiment_label=None,
                 main_topic="refund", review_status="review_completed"),
        analysis(14, 4, "2024-01-12 11:00:00", final_percentage_score=90.0, main_topic=None),
    ]
    revs = [review(91, 11, reviewer_id=1, opening_score_override=None), review(92, 11, reviewer_id=99),
            review(93, 13, reviewer_id=2)]
    us = [user(1, "ann", "2023-12-02 10:00:00.5"), user(2, "bob", "2023-12-01 10:00:00")]
    return tables(spark, calls, analyses, revs, us)


def test_kpis_empty_input_is_zeros(spark, t):
    row = dashboard.kpis(t, agent_id="nobody").first().asDict()
    assert row["total_conversations"] == 0 and row["sentiment_improvement"] == 0.0
    assert all(v == 0 for v in row.values())


def test_kpis_values(t):
    r = dashboard.kpis(t).first()
    assert r.total_conversations == 4 and r.average_score == pytest.approx((80 + 60 + 90) / 3)
    assert (r.positive_sentiment, r.negative_sentiment) == (2, 0)
    assert r.start_sentiment_negative == 3 and r.end_sentiment_positive == 4
    assert r.sentiment_improvement == pytest.approx(4 / 3 * 100)
    assert r.total_silence_seconds == 40.0


def test_leaderboard_null_average_ranks_first(t):
    rows = leaderboard.leaderboard(t).collect()
    assert [(r.rank, r.agent_extension) for r in rows] == [(1, "1002"), (2, "1001")]
    assert rows[0].average_score == 0.0  # NULL shown as 0 after ranking
    assert rows[1].average_opening_score == 1.0


def test_sentiment_distribution_absent_labels(t):
    r = dashboard.sentiment_distribution(t).first()
    assert (r.positive, r.negative, r.neutral) == (2, 0, 0)


def test_top_topics_excludes_null_and_empty(t):
    assert [(r.main_topic, r["count"]) for r in dashboard.top_topics(t).collect()] == [("billing", 1), ("refund", 1)]
    with pytest.raises(ValueError):
        dashboard.top_topics(t, limit=51)


def test_score_trends_groups_by_analysis_day(t):
    rows = dashboard.score_trends(t, date_range=None).collect()
    assert [(str(r.date), r.conversation_count) for r in rows] == [("2024-01-10", 1), ("2024-01-11", 1),
                                                                   ("2024-01-12", 2)]
    assert rows[2].average_score == 90.0


def test_agents_list(t):
    assert [r.agent_sender for r in leaderboard.agents_list(t).collect()] == ["1001", "1002"]
    assert leaderboard.agents_total(t).first().total == 2


def test_analyzed_page_fan_out_and_payloads(t):
    rows = conversations.analyzed_page(t, page_size=10).collect()
    # duplicate reviews of analysis 11 fan out; the total does not count them (Q4)
    assert [(r.id, r.human_review_id) for r in rows] == [(13, 93), (14, None), (12, None), (11, 91), (11, 92)]
    info = conversations.analyzed_page_info(t, page_size=2).first()
    assert (info.total, info.total_pages) == (4, 2)
    by_review = {r.human_review_id: r for r in rows}
    assert by_review[91].reviewer_username == "ann" and by_review[92].reviewer_username is None
    assert [x.text for x in by_review[91].conversation_data] == ["hi", "hello"]
    assert by_review[91].silence_timeline[0].end == 2.5
    assert str(by_review[91].created_at) == "2024-01-10 09:00:00"  # call time, not analysis time


def test_pages_past_the_end_and_bounds(t):
    assert conversations.analyzed_page(t, page=9, page_size=10).count() == 0
    with pytest.raises(ValueError):
        conversations.analyzed_page(t, page=0)
    with pytest.raises(ValueError):
        comparison.reviewed_page(t, page_size=501)


def test_unanalyzed_excludes_null(t):
    assert [r.id for r in conversations.unanalyzed_page(t).collect()] == [5]
    assert conversations.unanalyzed_page_info(t).first().total == 1


def test_pending_oldest_first_and_completed(t):
    assert [r.id for r in reviews.pending_reviews(t).collect()] == [12, 14]
    assert reviews.pending_reviews_total(t).first().total == 2
    assert [r.id for r in reviews.completed_reviews(t).collect()] == [13]
    assert [r.human_review_id for r in reviews.completed_reviews(t, status="completed").collect()] == [91, 92]
    assert reviews.completed_reviews_total(t, status="completed").first().total == 2


def test_review_by_analysis(t):
    rows = reviews.review_by_analysis(t, 11).collect()
    assert sorted((r.id, r.reviewer_full_name) for r in rows) == [(91, "User 1"), (92, None)]
    assert reviews.review_by_analysis(t, [13, 404]).count() == 1


def test_score_differences(t):
    rows = {(r.id, r.human_review_id): r.score_differences for r in comparison.score_differences(t).collect()}
    assert rows[(12, None)] is None
    d = rows[(11, 91)]
    assert d.opening == -1.0  # NULL override counts as 0 (Q5)
    assert rows[(13, 93)].opening == 1.0


def test_detail_by_ids(spark, t):
    assert {r.id for r in conversations.analyzed_detail(t, 12).collect()} == {12}
    ids = spark.createDataFrame([(11,), (14,)], "a long")
    assert sorted(r.id for r in conversations.analyzed_detail(t, ids).collect()) == [11, 11, 14]


def test_scripts(t):
    assert scripts.conversation_status(t, "CALL00000001").first().review_status == "completed"
    assert scripts.call_signals(t, ["CALL00000002"]).first().log_id == 2
    assert scripts.call_signals_direct(t, "CALL00000005").count() == 1
    assert scripts.completed_sample(t).first().id == 11
    assert [r.column_name for r in scripts.column_audit(t.conversation_analysis).collect()] == []
    assert [r.column_name for r in scripts.column_audit(t.conversations_log).collect()] == sorted(
        ["agent_clarity", "agent_energy", "agent_patience", "agent_tone", "user_sentiment_overall"])


def test_users_list_text_and_order(t):
    rows = users.users_list(t).collect()
    assert [(r.id, r.created_at) for r in rows] == [(1, "2023-12-02 10:00:00.5"), (2, "2023-12-01 10:00:00")]


def test_weights_and_max_score(spark, t):
    w = settings.weights(t).first().asDict()
    assert w == {"opening": 2.0, "listening": 12.0, "empathy": 10.0, "response_process": 16.0,
                 "system_updation": 12.0, "closing": 4.0}
    assert settings.max_score(t).first().max_score_per_metric == 4.0
    empty = t.with_(qc_settings=t.qc_settings.where(F.lit(False)))
    assert settings.weights(empty).first().response_process == 15.0
    assert settings.max_score(empty).first().max_score_per_metric == 4.0


def test_hot_agent_leaderboard(spark):
    """One agent holds a third of all calls: the ranking still equals a brute-force
    single-partition row_number (partial aggregation is visible in PLANS.md)."""
    from pyspark.sql import Window

    calls, analyses = [], []
    for i in range(1, 301):
        agent = "1000" if i % 3 == 0 else str(1001 + i % 40)
        calls.append(call(i, "2024-01-10 09:00:00", agent_sender=agent))
        analyses.append(analysis(10_000 + i, i, "2024-01-10 10:00:00", final_percentage_score=float(i % 7 * 10)))
    t = tables(spark, calls, analyses)
    lb = leaderboard.leaderboard(t)
    got = [(r.rank, r.agent_extension, r.total_conversations) for r in lb.collect()]
    assert dict((a, n) for _, a, n in got)["1000"] == 100
    raw = (dashboard.filtered_calls(t).groupBy("agent_sender").agg(F.avg("final_percentage_score").alias("s"))
           .withColumn("rank", F.row_number().over(Window.orderBy(F.col("s").desc_nulls_first(),
                                                                  F.col("agent_sender").asc_nulls_last()))))
    assert [(r.rank, r.agent_extension) for r in lb.collect()] == sorted(
        (r["rank"], r.agent_sender) for r in raw.collect())
