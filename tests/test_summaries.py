"""Panels from summaries equal the direct panels, for every filter, after merging and after changes."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from callqc.operators import dashboard, leaderboard, merges, summaries
from callqc.plans.facts import analysed_calls
from callqc.plans.stored import written
from callqc.sources.fixtures import AS_OF, FIXTURE_REVIEW_ID_OFFSET, fixture_tables, review_submissions

SF = "/root/testdata/sf0.001"
WINDOWS = [{}, {"date_range": "last7days"}, {"date_range": "yesterday"}, {"date_range": "custom", "start_date": "2024-01-05", "end_date": "2024-01-09"}]


@pytest.fixture(scope="module")
def facts(spark):
    return fixture_tables(spark, SF)


@pytest.fixture(scope="module")
def summary(facts):
    return written(summaries.summarise(analysed_calls(facts)), "summary")


@pytest.mark.parametrize("panel", ["kpis", "score_trends", "criteria_scores", "human_criteria_scores", "sentiment_distribution", "top_topics"])
def test_panels(facts, summary, panel):
    for window in WINDOWS:
        for agent in (None, "1003", "nobody"):
            direct = getattr(dashboard, panel)(facts, agent_id=agent, as_of=AS_OF, **window)
            ours = getattr(summaries, panel)(summary, agent_id=agent, as_of=AS_OF, **window)
            assert ours.dtypes == direct.dtypes and ours.collect() == direct.collect()


def test_leaderboard(facts, summary):
    for window in WINDOWS:
        assert summaries.leaderboard(summary, as_of=AS_OF, **window).collect() == leaderboard.leaderboard(facts, as_of=AS_OF, **window).collect()


def rows(summary):
    return sorted(map(str, summary.select("kind", *summaries.KEYS, *summaries.MEASURES).collect()))


def test_parts_merge_and_changes_apply(spark, facts, summary):
    f1 = analysed_calls(facts)
    parts = [summaries.summarise(f1.where(F.col("id") % 3 == k)) for k in range(3)]
    assert rows(summaries.merge(*parts)) == rows(summary)
    assert rows(summaries.merge(summary, summaries.summarise(f1.where("id % 2 = 0"), -1))) == rows(summaries.summarise(f1.where("id % 2 = 1")))
    assert summaries.merge(summary, summaries.summarise(f1, -1)).count() == 0
    merge = merges.submit_reviews(facts, review_submissions(spark, SF), lambda a: a + F.lit(FIXTURE_REVIEW_ID_OFFSET))
    changed, _ = merges.status_changes(facts, merge.accepted)
    after, _ = merges.review_status_updates(facts, merge.accepted)
    got = summaries.merge(summary, summaries.status_change(facts, changed))
    assert rows(got) == rows(summaries.summarise(analysed_calls(facts.with_(conversation_analysis=after))))
    assert summaries.summarise(f1.limit(0)).count() == 0


def test_one_fact_join_for_all_panels(facts):
    buffer = io.StringIO()
    with contextlib.redirect_stdout(buffer):
        summaries.summarise(analysed_calls(facts)).explain("simple")
    plan = buffer.getvalue()
    assert plan.count("FileScan") == 2 and plan.count("Join") == 1 and plan.count("Expand") == 1
