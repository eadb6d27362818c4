"""Day-range predicates agree with a plain-Python model on random timestamps."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from callqc.functions.filters import ALL_RANGES, date_range_filter, where_all

AS_OF = dt.date(2024, 1, 30)


def model(ts: dt.datetime, rng: str, start: dt.date, end: dt.date) -> bool:
    day0 = dt.datetime.combine(AS_OF, dt.time())
    if rng == "today":
        return ts >= day0
    if rng == "yesterday":
        return day0 - dt.timedelta(days=1) <= ts < day0
    if rng == "last7days":
        return ts >= day0 - dt.timedelta(days=7)
    if rng == "last30days":
        return ts >= day0 - dt.timedelta(days=30)
    if rng == "custom":
        return dt.datetime.combine(start, dt.time()) <= ts < dt.datetime.combine(end + dt.timedelta(days=1), dt.time())
    return True


times = st.datetimes(min_value=dt.datetime(2023, 12, 1), max_value=dt.datetime(2024, 2, 5))
days = st.dates(min_value=dt.date(2023, 12, 1), max_value=dt.date(2024, 2, 5))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(times, min_size=1, max_size=40), st.sampled_from(ALL_RANGES + ("other",)), days, days)
def test_ranges_match_model(spark, stamps, rng, a, b):
    start, end = min(a, b), max(a, b)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, c timestamp_ntz")
    pred = date_range_filter("c", rng, start.isoformat(), end.isoformat(), as_of=AS_OF)
    got = sorted(r.i for r in where_all(df, pred).collect())
    want = sorted(i for i, s in enumerate(stamps) if model(s, rng, start, end))
    assert got == want
