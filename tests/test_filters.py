"""Date ranges, agent / id / status filters on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from callqc.functions.filters import (
    ALL_RANGES,
    NO_YESTERDAY,
    TREND_RANGES,
    agent_filter,
    date_range_filter,
    id_search,
    status_filter,
    where_all,
)
from tests.helpers import ts

AS_OF = "2024-01-30"
TIMES = [
    "2023-12-30 23:59:59",  # 31 days + 1 s before as_of
    "2023-12-31 00:00:00",  # exactly 30 days before
    "2024-01-22 23:59:59",
    "2024-01-23 00:00:00",  # exactly 7 days before
    "2024-01-28 23:59:59",
    "2024-01-29 00:00:00",  # yesterday
    "2024-01-29 23:59:59.999999",
    "2024-01-30 00:00:00",  # today
    "2024-01-31 10:00:00",
]

EXPECTED = {
    "today": {"2024-01-30 00:00:00", "2024-01-31 10:00:00"},
    "yesterday": {"2024-01-29 00:00:00", "2024-01-29 23:59:59.999999"},
    "last7days": set(TIMES[3:]),
    "last30days": set(TIMES[1:]),
}


@pytest.fixture(scope="module")
def times(spark):
    return spark.createDataFrame([(t, ts(t)) for t in TIMES], "label string, c timestamp_ntz")


def labels(df, pred):
    return {r.label for r in where_all(df, pred).collect()}


@pytest.mark.parametrize("allowed", [ALL_RANGES, NO_YESTERDAY, TREND_RANGES])
@pytest.mark.parametrize("rng", ["today", "yesterday", "last7days", "last30days", "custom", "bogus", None])
def test_date_ranges(times, allowed, rng):
    pred = date_range_filter("c", rng, "2024-01-22", "2024-01-29", as_of=AS_OF, allowed=allowed)
    got = labels(times, pred)
    if rng not in allowed:
        assert pred is None and got == set(TIMES)
    elif rng == "custom":
        assert got == {t for t in TIMES if "2024-01-22" <= t[:10] <= "2024-01-29"}
    else:
        assert got == EXPECTED[rng]


def test_custom_needs_both_dates(times):
    assert date_range_filter("c", "custom", "2024-01-01", None, as_of=AS_OF) is None
    assert date_range_filter("c", None, "2024-01-01", "2024-01-02", as_of=AS_OF) is None


def test_default_as_of_is_current_date(times):
    pred = date_range_filter("c", "today", as_of=None)
    assert "current_date" in str(pred).lower()


def test_agent_filter(spark):
    df = spark.createDataFrame([("1001",), ("1002",), (None,)], "agent_sender string")
    assert agent_filter(None) is None and agent_filter("") is None and agent_filter("all") is None
    assert [r.agent_sender for r in df.where(agent_filter("1002")).collect()] == ["1002"]


def test_id_search_wildcards(spark):
    df = spark.createDataFrame([("CALL00000101",), ("call0000x1",), ("CALL00000201",), ("AB%CD",)], "unique_id string")
    assert id_search("   ") is None and id_search(None) is None
    got = {r.unique_id for r in df.where(id_search(" 00001 ")).collect()}
    assert got == {"CALL00000101"}
    # '_' matches any single character, '%' any run, case-insensitively
    got = {r.unique_id for r in df.where(id_search("0_01")).collect()}
    assert got == {"CALL00000101", "CALL00000201"}
    got = {r.unique_id for r in df.where(id_search("call%x")).collect()}
    assert got == {"call0000x1"}


def test_status_filter(spark):
    df = spark.createDataFrame([("completed",), ("pending_review",)], "review_status string")
    assert status_filter("") is None
    assert df.where(status_filter("completed")).count() == 1
    assert where_all(df).count() == 2
    assert where_all(df, None, F.lit(False)).count() == 0
