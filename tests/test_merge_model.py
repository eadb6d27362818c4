"""Batch review merge == applying the submissions one request at a time (reference order)."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callqc.operators import merges
from callqc.sources import schemas
from tests.helpers import K, analysis, call, frame, review, tables

DEFAULTS = {"opening": 2, "listening": 12, "empathy": 10, "response_process": 15, "system_updation": 12, "closing": 4}
SNAPSHOTS = [None, "{}", '{"opening":3,"listening":12,"empathy":10,"response_process":11,"system_updation":12,"closing":4}',
             '{"opening":2,"responseProcess":20,"systemUpdation":8}', '{"closing":9}']
VALUES = ["reviewer_id", "opening_score_override", "strengths_override", "total_weighted_score_human",
          "final_percentage_score_human", "other_criteria_weighted_score_human", "other_criteria_percentage_score_human"]


def model(analyses, reviews, feed, max_score=4.0):
    """Sequential application, as the request handler does it."""
    ca = {a["id"]: dict(a) for a in analyses}
    crh = [dict(r) for r in reviews]
    cl_status = {}
    for s in sorted(feed, key=lambda r: r["seq"]):
        a = s["analysis_id"]
        existing = [r for r in crh if r["analysis_id"] == a]
        if existing:
            for r in existing:
                for v in VALUES:
                    r[v] = s[v]
        else:
            snap = ca[a]["weights_snapshot"] if a in ca else None
            if not snap or not json.loads(snap):
                continue  # rejected, nothing written
            w = json.loads(snap)
            crh.append(dict({v: s[v] for v in VALUES}, id=a + 1000, analysis_id=a, weights_snapshot=snap,
                            max_possible_overall_score=max_score * sum(w.get(k, d) for k, d in DEFAULTS.items())))
        if a in ca:
            ca[a]["review_status"] = "completed"
            cl_status[ca[a]["conversation_id"]] = "completed"
    return crh, {k: v["review_status"] for k, v in ca.items()}, cl_status


sub_st = st.fixed_dictionaries({
    "analysis_id": st.integers(101, 108),
    "reviewer_id": st.integers(1, 3),
    "opening_score_override": st.one_of(st.none(), st.sampled_from([0.5, 1.0, 3.5])),
    "strengths_override": st.one_of(st.none(), st.sampled_from(["a", "b"])),
    "total_weighted_score_human": st.sampled_from([1.0, 2.25, 7.5]),
})


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    snaps=st.lists(st.sampled_from(range(len(SNAPSHOTS))), min_size=6, max_size=6),
    reviewed=st.lists(st.sampled_from([101, 102, 103, 104, 105, 106, 107]), max_size=4),
    subs=st.lists(sub_st, min_size=1, max_size=12),
)
def test_batch_merge_equals_sequential_requests(spark, snaps, reviewed, subs):
    analyses = [analysis(101 + i, 1 + i, "2024-01-10 10:00:00", weights_snapshot=SNAPSHOTS[k])
                for i, k in enumerate(snaps)]
    calls = [call(1 + i, "2024-01-10 09:00:00") for i in range(6)]
    reviews = [review(900 + j, a, reviewer_id=2, weights_snapshot="{}", max_possible_overall_score=1.0)
               for j, a in enumerate(reviewed)]  # duplicates per analysis allowed; 107 has no analysis row
    feed_rows = []
    for seq, s in enumerate(subs):
        t_ = s["total_weighted_score_human"]
        feed_rows.append(dict(s, seq=seq, final_percentage_score_human=t_, other_criteria_weighted_score_human=t_,
                              other_criteria_percentage_score_human=t_))
    t = tables(spark, calls, analyses, reviews)
    m = merges.submit_reviews(t, frame(spark, schemas.review_submissions(K), feed_rows), lambda a: a + F.lit(1000))
    new_ca, new_cl = merges.review_status_updates(t, m.accepted)

    want_crh, want_status, want_qc = model(analyses, [dict(r, **{v: r.get(v) for v in VALUES}) for r in reviews],
                                           feed_rows)
    cols = ["id", "analysis_id", *VALUES, "weights_snapshot", "max_possible_overall_score"]
    got = sorted(tuple(r[c] for c in cols) for r in m.reviews.collect())
    assert got == sorted(tuple(r.get(c) for c in cols) for r in want_crh)
    assert {r.id: r.review_status for r in new_ca.collect()} == want_status
    assert {r.id: r.qc_status for r in new_cl.collect() if r.qc_status == "completed"} == want_qc
