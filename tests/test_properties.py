"""Properties over the derived sf0.001 tables."""

from pyspark.sql import functions as F

from callqc.operators import comparison, conversations, dashboard, merges
from callqc.sources.fixtures import AS_OF, FIXTURE_REVIEW_ID_OFFSET, fixture_tables, review_submissions

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_pages_concatenate_to_the_full_listing(spark):
    t = fixture_tables(spark, SF)
    kw = dict(date_range="last30days", as_of=AS_OF)
    whole = rows(conversations.analyzed_page(t, page_size=84, **kw).drop("conversation_data", "silence_timeline"))
    parts = []
    for p in range(1, 8):
        parts += rows(conversations.analyzed_page(t, page=p, page_size=12, **kw)
                      .drop("conversation_data", "silence_timeline"))
    assert parts == whole


def test_reviewed_and_backlog_pages_concatenate(spark):
    t = fixture_tables(spark, SF)
    whole = rows(comparison.reviewed_page(t, page_size=60, as_of=AS_OF))
    parts = sum((rows(comparison.reviewed_page(t, page=p, page_size=20, as_of=AS_OF)) for p in (1, 2, 3)), [])
    assert parts == whole
    whole = rows(conversations.unanalyzed_page(t, page_size=30))
    parts = sum((rows(conversations.unanalyzed_page(t, page=p, page_size=10)) for p in (1, 2, 3)), [])
    assert parts == whole


def test_day_counts_sum_to_kpi_total(spark):
    t = fixture_tables(spark, SF)
    for kw in (dict(date_range="last30days"), dict(date_range="custom", start_date="2024-01-03",
                                                   end_date="2024-01-17", agent_id="1004")):
        days = dashboard.score_trends(t, as_of=AS_OF, **kw).agg(F.sum("conversation_count")).first()[0] or 0
        assert days == dashboard.kpis(t, as_of=AS_OF, **kw).first().total_conversations


def test_page_info_matches_listing_length(spark):
    t = fixture_tables(spark, SF)
    info = conversations.analyzed_page_info(t, status="completed", page_size=7, as_of=AS_OF).first()
    assert info.total == conversations.analyzed_page(t, status="completed", page_size=10000).count()
    assert info.total_pages == (info.total + 6) // 7


def test_submit_accounting_and_idempotence(spark):
    t = fixture_tables(spark, SF)
    feed = review_submissions(spark, SF)
    rid = lambda a: a + F.lit(FIXTURE_REVIEW_ID_OFFSET)
    m = merges.submit_reviews(t, feed, rid)
    assert m.accepted.count() + m.rejected.count() == feed.select("analysis_id").distinct().count()
    again = merges.submit_reviews(t.with_(conversation_review_human=m.reviews), feed, rid)
    assert sorted(rows(again.reviews)) == sorted(rows(m.reviews))
    counts = {r.action: r["count"] for r in m.actions.groupBy("action").count().collect()}
    assert counts == {"update": 42, "insert": 56, "reject": 102}  # FIXTURES.md part C at sf0.001


def test_pages_are_slices_of_the_whole_listing(spark):
    t = fixture_tables(spark, SF)
    cases = [
        lambda page, size: conversations.analyzed_page(t, page=page, page_size=size, date_range="last30days", as_of=AS_OF)
        .drop("conversation_data", "silence_timeline"),
        lambda page, size: comparison.reviewed_page(t, page=page, page_size=size, as_of=AS_OF),
        lambda page, size: conversations.unanalyzed_page(t, page=page, page_size=size),
    ]
    for c in cases:
        full = rows(c(1, 500))
        assert len(full) > 60
        for page, size in ((1, 25), (3, 25), (4, 15)):
            assert rows(c(page, size)) == full[(page - 1) * size : page * size]


def test_pages_with_duplicate_reviews(spark):
    from tests.helpers import analysis, call, review, tables

    t = tables(spark,
               [call(i, f"2024-01-{10 + i} 09:00:00") for i in range(1, 6)],
               [analysis(10 + i, i, f"2024-01-{10 + i} 11:00:00") for i in range(1, 6)],
               [review(90 + k, 13, reviewer_id=1) for k in range(4)] + [review(99, 11)])
    full = rows(conversations.analyzed_page(t, page_size=100))
    assert len(full) == 8
    for size in (1, 2, 3):
        pages = [rows(conversations.analyzed_page(t, page=p, page_size=size)) for p in range(1, 10)]
        assert sum(pages, []) == full


def test_overview_equals_separate_panels(spark):
    t = fixture_tables(spark, SF)
    for rng in (None, "today", "yesterday", "last7days", "last30days", "custom"):
        kw = dict(date_range=rng, start_date="2024-01-05", end_date="2024-01-12", as_of=AS_OF)
        both = dashboard.overview(t, **kw).first().asDict()
        parts = {}
        for f in (dashboard.kpis, dashboard.criteria_scores, dashboard.human_criteria_scores,
                  dashboard.sentiment_distribution):
            parts.update(f(t, **kw).first().asDict())
        assert both == parts, rng
