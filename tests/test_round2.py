"""Column overlap of the facts, odd search texts, the feed's span, changed rows, file counts."""

import pathlib
import tempfile

import pytest
from pyspark.sql import functions as F

from callqc.functions.filters import id_search
from callqc.operators import comparison, conversations, merges, reviews, scripts
from callqc.sources.fixtures import FIXTURE_REVIEW_ID_OFFSET, fixture_tables, review_submissions
from callqc.sources.sinks import write_tables

SF = "/root/testdata/sf0.001"


def test_listings_show_the_later_of_equal_names(spark):
    t = fixture_tables(spark, SF)
    more = t.conversation_analysis.withColumns({"agent_tone": F.lit("theirs"), "qc_status": F.lit("own"), "reviewer_id": F.lit(7)})
    both = t.with_(conversation_analysis=more)
    for make in (lambda x: conversations.analyzed_page(x, page_size=40), lambda x: conversations.analyzed_detail(x, [5_000_000_003]),
                 lambda x: comparison.score_differences(x, [5_000_000_003]), reviews.pending_reviews):
        want, got = make(t), make(both)
        names = [c for c in got.columns if c in want.columns]
        assert got.columns.count("agent_tone") == 1 and "qc_status" in got.columns
        assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
        assert {r.qc_status for r in got.select("qc_status").collect()} == {"own"}
    assert sorted(map(tuple, scripts.call_signals(both).collect())) == sorted(map(tuple, scripts.call_signals(t).collect()))


@pytest.mark.parametrize(("text", "hits"), [("a\\b", {"xaby"}), ("\\%", {"x%y"}), ("\\_", {"x_y"}), ("x_y", {"x_y", "x%y", "xay", "x\\y"}), ("\\\\", {"x\\y"})])
def test_backslashes_in_a_search(spark, text, hits):
    df = spark.createDataFrame([("xaby",), ("x%y",), ("x_y",), ("xay",), ("x\\y",)], "unique_id string")
    assert {r.unique_id for r in df.where(id_search(text)).collect()} == hits


def test_the_feed_spans_the_analyses_at_every_scale(spark):
    small, large = (review_submissions(spark, f"/root/testdata/{sf}").select("analysis_id").distinct().count() for sf in ("sf0.001", "sf0.01"))
    assert large > 8 * small


def test_status_changes_are_the_changed_rows(spark):
    t = fixture_tables(spark, SF)
    accepted = merges.submit_reviews(t, review_submissions(spark, SF), lambda a: a + F.lit(FIXTURE_REVIEW_ID_OFFSET)).accepted
    new_ca, new_cl = merges.review_status_updates(t, accepted)
    analyses, calls = merges.status_changes(t, accepted)
    before = {r.id: r.review_status for r in t.conversation_analysis.collect()}
    after = {r.id: r.review_status for r in new_ca.select("id", "review_status").collect()}
    assert {r.id: r.review_status for r in analyses.collect()} == {i: s for i, s in after.items() if s != before[i]}
    before = {r.id: r.qc_status for r in t.conversations_log.select("id", "qc_status").collect()}
    after = {r.id: r.qc_status for r in new_cl.select("id", "qc_status").collect()}
    assert {r.id: r.qc_status for r in calls.collect()} == {i: s for i, s in after.items() if s != before[i]}
    for df in (analyses, calls):
        assert "conversation_data" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_day_is_written_to_few_files(spark):
    t = fixture_tables(spark, SF)
    t = t.with_(conversation_analysis=t.conversation_analysis.repartition(40))
    out = tempfile.mkdtemp(prefix="callqc-files-")
    write_tables(t, out)
    files = list(pathlib.Path(out, "conversation_analysis").rglob("*.parquet"))
    days = {f.parent for f in files}
    assert len(files) <= 2 * len(days)
