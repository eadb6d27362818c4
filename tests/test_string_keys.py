"""The operators are key-type agnostic: text (UUID-like) ids behave like the bigint fixtures."""

from pyspark.sql import types as T

from callqc.operators import comparison, conversations, leaderboard, merges, reviews
from callqc.sources import schemas
from callqc.sources.tables import Tables
from tests.helpers import analysis, call, frame, review, ts, user

S = T.StringType()


def u(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def test_string_ids(spark):
    calls = [dict(call(1, "2024-01-10 09:00:00"), id=u(1)), dict(call(2, "2024-01-11 09:00:00"), id=u(2))]
    analyses = [dict(analysis(0, 0, "2024-01-10 10:00:00", review_status="completed"), id=u(11), conversation_id=u(1)),
                dict(analysis(0, 0, "2024-01-11 10:00:00"), id=u(12), conversation_id=u(2))]
    revs = [dict(review(0, 0), id=u(91), analysis_id=u(11), reviewer_id=u(501))]
    users = [dict(user(0, "ann"), id=u(501))]
    t = Tables(
        conversations_log=frame(spark, schemas.conversations_log(S), calls),
        conversation_analysis=frame(spark, schemas.conversation_analysis(S), analyses),
        conversation_review_human=frame(spark, schemas.conversation_review_human(S), revs),
        qc_users=frame(spark, schemas.qc_users(S), users),
        qc_settings=frame(spark, schemas.qc_settings(), [dict(setting_key="max_score_per_metric",
                                                             setting_value="5", updated_at=ts("2024-01-01 00:00:00"))]),
    )
    page = conversations.analyzed_page(t).collect()
    assert [(r.id, r.human_review_id, r.reviewer_username) for r in page] == [(u(12), None, None), (u(11), u(91), "ann")]
    assert comparison.reviewed_page(t).count() == 0  # call qc_status is 'pending'
    assert reviews.review_by_analysis(t, u(11)).first().reviewer_full_name == "User 0"
    assert [r.agent_extension for r in leaderboard.leaderboard(t).collect()] == ["1001"]

    feed = frame(spark, schemas.review_submissions(S), [
        dict(seq=1, analysis_id=u(12), reviewer_id=u(501), total_weighted_score_human=3.0,
             final_percentage_score_human=3.0, other_criteria_weighted_score_human=3.0,
             other_criteria_percentage_score_human=3.0)])
    m = merges.submit_reviews(t, feed)
    new = {r.analysis_id: r for r in m.reviews.collect()}
    assert new[u(12)].id == f"review-{u(12)}" and new[u(12)].max_possible_overall_score == 5 * 55
    ca, cl = merges.review_status_updates(t, m.accepted)
    assert {r.id: r.qc_status for r in cl.collect()} == {u(1): "pending", u(2): "completed"}
