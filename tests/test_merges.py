"""Batch merges: every branch of review submission, user and setting changes."""

from pyspark.sql import functions as F

from callqc.operators import merges
from callqc.sources import schemas
from tests.helpers import K, analysis, call, frame, review, tables, ts, user

SNAP = '{"opening":3,"listening":12,"empathy":10,"response_process":11,"system_updation":12,"closing":4}'
CAMEL = '{"opening":2,"listening":12,"empathy":10,"responseProcess":20,"systemUpdation":8,"closing":4}'


def sub(seq, analysis_id, reviewer_id=7, total=1.0, **kw):
    base = dict(seq=seq, analysis_id=analysis_id, reviewer_id=reviewer_id, total_weighted_score_human=total,
                final_percentage_score_human=total, other_criteria_weighted_score_human=total,
                other_criteria_percentage_score_human=total)
    base.update(kw)
    return base


def world(spark, settings=None):
    calls = [call(i, f"2024-01-0{i} 10:00:00") for i in range(1, 6)]
    analyses = [
        analysis(101, 1, "2024-01-01 12:00:00", weights_snapshot=SNAP),
        analysis(102, 2, "2024-01-02 12:00:00", weights_snapshot=None),
        analysis(103, 3, "2024-01-03 12:00:00", weights_snapshot="{}"),
        analysis(104, 4, "2024-01-04 12:00:00", weights_snapshot=CAMEL),
        analysis(105, 5, "2024-01-05 12:00:00", weights_snapshot=None),
    ]
    reviews = [review(900, 105, reviewer_id=1, strengths_override="keep?", weights_snapshot="{}",
                      max_possible_overall_score=99.0)]
    return tables(spark, calls, analyses, reviews, [user(1, "u1"), user(7, "u7")], settings)


def feed(spark, rows):
    return frame(spark, schemas.review_submissions(K), rows)


def test_submit_branches(spark):
    t = world(spark)
    f = feed(spark, [
        sub(1, 101, total=5.0, opening_score_override=1.5),   # insert (then updated by seq 4)
        sub(4, 101, total=6.0, opening_score_override=None),
        sub(2, 102), sub(3, 103),                               # rejected: NULL / empty snapshot
        sub(5, 104, total=8.0),                                 # insert, camelCase snapshot
        sub(6, 105, total=9.0, strengths_override=None),        # update of an existing review
        sub(7, 999),                                            # rejected: analysis missing
    ])
    m = merges.submit_reviews(t, f, lambda a: a + F.lit(1000))
    actions = {r.analysis_id: (r.seq, r.action, r.reason) for r in m.actions.collect()}
    assert actions == {
        101: (4, "insert", None), 102: (2, "reject", "weights_snapshot_missing"),
        103: (3, "reject", "weights_snapshot_missing"), 104: (5, "insert", None), 105: (6, "update", None),
        999: (7, "reject", "analysis_not_found"),
    }
    out = {r.analysis_id: r for r in m.reviews.collect()}
    assert set(out) == {101, 104, 105}
    # last submission wins; NULL overwrites
    assert out[101].id == 1101 and out[101].total_weighted_score_human == 6.0 and out[101].opening_score_override is None
    assert out[101].weights_snapshot == SNAP
    assert out[101].max_possible_overall_score == 4 * (3 + 12 + 10 + 11 + 12 + 4)
    # camelCase keys are not read by the snapshot reader: defaults 15 and 12 apply
    assert out[104].max_possible_overall_score == 4 * (2 + 12 + 10 + 15 + 12 + 4)
    # update keeps id, snapshot and max possible, overwrites reviewer and values
    u = out[105]
    assert (u.id, u.reviewer_id, u.total_weighted_score_human, u.strengths_override) == (900, 7, 9.0, None)
    assert (u.weights_snapshot, u.max_possible_overall_score) == ("{}", 99.0)
    assert m.accepted.count() + m.rejected.count() == f.select("analysis_id").distinct().count()


def test_submit_is_idempotent(spark):
    t = world(spark)
    f = feed(spark, [sub(1, 101, total=5.0), sub(2, 104, total=8.0), sub(3, 105, total=9.0)])
    once = merges.submit_reviews(t, f, lambda a: a + F.lit(1000)).reviews
    twice = merges.submit_reviews(t.with_(conversation_review_human=once), f, lambda a: a + F.lit(1000)).reviews
    assert sorted(once.collect()) == sorted(twice.collect())


def test_max_score_setting_absent_uses_default(spark):
    t = world(spark, settings=[dict(setting_key="weights", setting_value="{}")])
    m = merges.submit_reviews(t, feed(spark, [sub(1, 101)]), lambda a: a + F.lit(1000))
    assert m.reviews.where("analysis_id = 101").first().max_possible_overall_score == 4 * 52


def test_status_updates(spark):
    t = world(spark)
    m = merges.submit_reviews(t, feed(spark, [sub(1, 101), sub(2, 102), sub(3, 105), sub(4, 999)]),
                              lambda a: a + F.lit(1000))
    ca, cl = merges.review_status_updates(t, m.accepted)
    status = {r.id: r.review_status for r in ca.collect()}
    assert status == {101: "completed", 102: "pending_review", 103: "pending_review", 104: "pending_review",
                      105: "completed"}
    qc = {r.id: r.qc_status for r in cl.collect()}
    assert qc == {1: "completed", 2: "pending", 3: "pending", 4: "pending", 5: "completed"}
    assert ca.columns == t.conversation_analysis.columns and cl.columns == t.conversations_log.columns


def changes(spark, rows):
    full = [dict(dict(seq=None, op=None, id=None, username=None, full_name=None, role=None, is_active=None), **r)
            for r in rows]
    return frame(spark, schemas.user_changes(K), full)


def test_user_changes(spark):
    users = frame(spark, schemas.qc_users(K), [user(1, "ann", full_name="Ann"), user(2, "bob"), user(3, "cy")])
    ch = changes(spark, [
        dict(seq=1, op="create", id=10, username="dan", full_name="Dan"),
        dict(seq=2, op="create", id=11, username="dan"),                       # duplicate in feed
        dict(seq=3, op="create", id=12, username="bob"),                       # duplicate of table
        dict(seq=4, op="update", id=1, role="admin"),
        dict(seq=5, op="update", id=1, full_name="Ann B", role=None),
        dict(seq=6, op="update", id=2),                                       # empty patch
        dict(seq=7, op="delete", id=3),
        dict(seq=8, op="update", id=3, full_name="ghost"),                     # after delete: void
        dict(seq=9, op="update", id=10, is_active=False, role="supervisor"),
        dict(seq=10, op="update", id=77, full_name="nobody"),                  # unknown id
        dict(seq=11, op="delete", id=78),                                      # unknown id
    ])
    out, rejected = merges.apply_user_changes(users, ch)
    got = {r.id: (r.username, r.full_name, r.role, r.is_active) for r in out.collect()}
    assert got == {
        1: ("ann", "Ann B", "admin", True),
        2: ("bob", "User 2", "agent", True),
        10: ("dan", "Dan", "supervisor", False),
    }
    rej = {(r.seq, r.reason) for r in rejected.collect()}
    assert rej == {(2, "duplicate_username"), (3, "duplicate_username"), (6, "empty_update")}
    assert out.columns == users.columns


def test_setting_changes(spark):
    settings = frame(spark, schemas.qc_settings(), [
        dict(setting_key="weights", setting_value="{}", updated_by="x", updated_at=ts("2024-01-01 00:00:00")),
        dict(setting_key="max_score_per_metric", setting_value="4"),
    ])
    value = merges.weights_setting_value(1, 2, 3, 4, 5, 6)
    ch = spark.createDataFrame(
        [(1, "weights", "{}", "a", ts("2024-01-02 00:00:00")), (3, "unknown", "1", "c", ts("2024-01-02 00:00:00"))],
        "seq long, setting_key string, setting_value string, updated_by string, updated_at timestamp_ntz",
    ).withColumn("setting_value", value).unionByName(spark.createDataFrame(
        [(2, "weights", '{"opening":9.0}', "b", ts("2024-01-03 00:00:00"))],
        "seq long, setting_key string, setting_value string, updated_by string, updated_at timestamp_ntz"))
    out = {r.setting_key: r for r in merges.apply_setting_changes(settings, ch).collect()}
    assert set(out) == {"weights", "max_score_per_metric"}
    assert out["weights"].setting_value == '{"opening":9.0}' and out["weights"].updated_by == "b"
    assert out["max_score_per_metric"].setting_value == "4" and out["max_score_per_metric"].updated_by is None
    j = spark.range(1).select(value.alias("v")).first().v
    assert j == ('{"opening":1.0,"listening":2.0,"empathy":3.0,"responseProcess":4.0,'
                 '"systemUpdation":5.0,"closing":6.0}')
