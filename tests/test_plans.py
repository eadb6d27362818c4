"""Plan shapes: pages are fetched by their keys, existence is a semi join, no Python in the plans,
date predicates reach the parquet scan of stored tables."""

import contextlib
import dataclasses
import io
import os
import re
import tempfile

import pytest

from callqc import registry
from callqc.operators import comparison, conversations, dashboard, leaderboard
from callqc.sources import tables as tables_mod
from callqc.sources.fixtures import fixture_tables
from callqc.sources.sinks import write_tables

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_pages_fetch_by_their_keys_at_every_depth(spark):
    t = fixture_tables(spark, SF)
    shapes = []
    for page in (1, 5):
        p = plan(conversations.analyzed_page(t, page=page, page_size=100), "simple")
        assert "LeftSemi, BuildRight" in p  # reviews and turns streamed past the page keys
        assert p.count("Window") == 0
        shapes.append(re.findall(r"\b[A-Z]\w*(?:Join|Aggregate|Exchange)\b", p))
    assert shapes[0] == shapes[1]
    assert conversations.analyzed_page(t, page=40_000_000, page_size=100).count() == 0  # past INT


def test_page_keys_are_joined_within_the_page_hours(spark):
    """The second key join reads the calls of the page's hours: a bound on the time in the scan."""
    t = fixture_tables(spark, SF)
    seen = []
    keys = conversations._analyzed_keys(t, None, None, None, None, None, None, None)
    spied = dataclasses.replace(keys, source=lambda span: seen.append(keys.source(span)) or seen[-1])
    assert spied.cut(0, 20).count() == 20
    p = plan(seen[-1], "simple")
    assert len(seen) == 1 and re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,2024-01-30", p)


@pytest.mark.parametrize("panel", ["kpis", "overview", "top_topics", "score_trends", "leaderboard", "reviewed_page_info"])
def test_day_windows_prune_the_calls(spark, panel):
    """Files of days that no analysis of the window belongs to are not read: they hold no Parquet."""
    t = fixture_tables(spark, SF)
    out = tempfile.mkdtemp(prefix="callqc-window-")
    write_tables(t, out)
    stored = tables_mod.load_parquet(spark, out)
    make = {"leaderboard": leaderboard.leaderboard, "reviewed_page_info": comparison.reviewed_page_info}.get(panel) or getattr(dashboard, panel)
    window = dict(date_range="custom", start_date="2024-01-10", end_date="2024-01-12")
    want = make(t, **window).collect()
    df = make(stored, **window)
    p = plan(df)
    assert re.search(r"conversations_log[\s\S]*?PartitionFilters: \[\(isnull\(created_date[^\n]*array_contains\(Subquery", p)
    for day in os.listdir(f"{out}/conversations_log"):
        if day.startswith("created_date=") and not "created_date=2024-01-09" <= day <= "created_date=2024-01-12":
            for name in os.listdir(f"{out}/conversations_log/{day}"):
                with open(f"{out}/conversations_log/{day}/{name}", "wb") as f:
                    f.write(b"not read")
    assert df.collect() == want


def test_fetched_rows_equal_the_page(spark):
    t = fixture_tables(spark, SF)
    for page in (1, 5):
        rows = conversations.analyzed_page(t, page=page, page_size=7)
        assert rows.count() == 7


@pytest.mark.parametrize("name", ["score_differences", "analyzed_detail"])
def test_details_read_each_fact_once_for_keys_and_payloads_move_last(spark, name):
    out = tempfile.mkdtemp(prefix="callqc-details-")
    write_tables(fixture_tables(spark, SF), out)
    stored = tables_mod.load_parquet(spark, out)
    make = {"score_differences": comparison.score_differences, "analyzed_detail": conversations.analyzed_detail}[name]
    p = plan(make(stored), "simple")
    scans = [line for line in p.splitlines() if "FileScan" in line]
    assert sum("conversation_analysis" in line for line in scans) == 1
    assert sum("conversations_log" in line for line in scans) == 2  # narrow columns, payloads


def test_agents_list_is_semi_join(spark):
    assert "LeftSemi" in plan(leaderboard.agents_list(fixture_tables(spark, SF)), "simple")


def test_leaderboard_ranks_without_single_partition_window(spark):
    p = plan(leaderboard.leaderboard(fixture_tables(spark, SF)), "simple")
    assert "hashpartitioning(_bucket" in p


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_no_python_in_plans(spark, key):
    p = plan(registry.queries()[key](spark, SF), "simple")
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in p


def test_date_filter_pushed_to_stored_tables(spark):
    t = fixture_tables(spark, SF)
    out = tempfile.mkdtemp(prefix="callqc-tables-")
    write_tables(t, out)
    stored = tables_mod.load_parquet(spark, out)
    df = dashboard.kpis(stored, agent_id="1003", date_range="last7days", as_of="2024-01-30")
    p = plan(df)
    assert "GreaterThanOrEqual(created_at,2024-01-23T00:00)" in p
    assert "EqualTo(agent_sender,1003)" in p
    assert "PartitionFilters: [isnotnull(created_date" in p
    assert df.first().asDict() == dashboard.kpis(t, agent_id="1003", date_range="last7days",
                                                 as_of="2024-01-30").first().asDict()


def test_bucketed_fact_join_has_no_exchange(spark):
    from callqc.plans.facts import analysed_calls
    from callqc.sources.sinks import save_bucketed_tables

    t = fixture_tables(spark, SF)
    save_bucketed_tables(t, "qc_bucketed", 4, mode="overwrite")
    stored = tables_mod.load_catalog(spark, "qc_bucketed")
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = analysed_calls(stored).select("id", "agent_sender")
        p = plan(df, "simple")
        assert "SortMergeJoin" in p and "Exchange" not in p
        assert df.count() == analysed_calls(t).count()
        assert dashboard.kpis(stored, as_of="2024-01-30").first() == dashboard.kpis(t, as_of="2024-01-30").first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "64m")


def test_page_fetch_reads_only_the_page_days(spark):
    t = fixture_tables(spark, SF)
    out = tempfile.mkdtemp(prefix="callqc-pagedays-")
    write_tables(t, out)
    stored = tables_mod.load_parquet(spark, out)
    for kw in (dict(page_size=30), dict(page=2, page_size=20, agent_id="1004"), dict(date_range="yesterday",
                                                                                    as_of="2024-01-30")):
        want = conversations.analyzed_page(t, **kw).drop("conversation_data", "silence_timeline").collect()
        df = conversations.analyzed_page(stored, **kw)
        got = df.drop("conversation_data", "silence_timeline").collect()
        assert got == want
    df.collect()
    p = plan(df)
    assert "PartitionFilters: [(isnull(created_date" in p and "(created_date" in p and "Subquery subquery" in p
    stored_payloads = conversations.analyzed_page(stored, page_size=30).where("conversation_data IS NOT NULL")
    derived_payloads = conversations.analyzed_page(t, page_size=30).where("conversation_data IS NOT NULL")
    assert stored_payloads.count() == derived_payloads.count()


def test_turns_as_rows_layout_round_trip(spark):
    t = fixture_tables(spark, SF)
    out = tempfile.mkdtemp(prefix="callqc-turns-")
    write_tables(t, out, turns_as_rows=True)
    stored = tables_mod.load_parquet(spark, out, turns=True)
    for f in (lambda x: conversations.analyzed_page(x, page_size=1000, date_range="last30days", as_of="2024-01-30"),
              lambda x: conversations.analyzed_detail(x, [5000000003, 5000000005])):
        want = sorted(map(tuple, f(t).collect()))
        got = sorted(map(tuple, f(stored).collect()))
        assert got == want
