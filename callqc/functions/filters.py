"""Optional request filters as Spark predicates.

Every builder returns ``None`` when its parameter is unset, mirroring a handler that
only appends a WHERE clause for parameters it received; ``where_all`` folds what is
left with AND.  Bounds are literals computed on the driver, so the predicates compare
the raw ``created_at`` column with a constant and reach the parquet scan as pushed
filters (and partition filters on date-partitioned tables).
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_RANGES = ("today", "yesterday", "last7days", "last30days", "custom")
# The criteria, human-criteria, top-topics and sentiment panels have no "yesterday" branch.
NO_YESTERDAY = ("today", "last7days", "last30days", "custom")
# Daily trends accept only these three and default to the last seven days.
TREND_RANGES = ("last7days", "last30days", "custom")


def _as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value).strip()[:10])


def _day(as_of, minus_days: int = 0) -> Column:
    if as_of is None:
        return F.date_sub(F.current_date(), minus_days) if minus_days else F.current_date()
    return F.lit(_as_date(as_of) - dt.timedelta(days=minus_days))


def date_range_filter(
    column: str | Column,
    date_range: str | None,
    start_date=None,
    end_date=None,
    as_of=None,
    allowed: tuple[str, ...] = ALL_RANGES,
) -> Column | None:
    """Half-open day ranges on ``column``; ``as_of`` is "today" (default: current_date()).

    A value outside ``allowed``, or dates without ``custom``, restricts nothing.
    """
    bounds = _day_bounds(date_range, start_date, end_date, as_of, allowed)
    return None if bounds is None else _within(F.col(column) if isinstance(column, str) else column, *bounds)


def _within(c: Column, lower: Column | None, upper: Column | None) -> Column:
    kept = [p for p in (lower is not None and c >= lower, upper is not None and c < upper) if p is not False]
    return reduce(lambda x, y: x & y, kept)


#: Storage columns: the day of a fact row (its partition), and on analyses the day of their call.
PARTITION_COLUMN, CALL_DAY = "created_date", "call_date"


def _day_bounds(date_range, start_date, end_date, as_of, allowed):
    """(lower, upper) day bounds as Columns (either may be None), or None for no filter."""
    if date_range not in allowed:
        return None
    if date_range == "today":
        return _day(as_of), None
    if date_range == "yesterday":
        return _day(as_of, 1), _day(as_of)
    if date_range == "last7days":
        return _day(as_of, 7), None
    if date_range == "last30days":
        return _day(as_of, 30), None
    if date_range == "custom" and start_date and end_date:
        start, end = _as_date(start_date), _as_date(end_date)
        return F.lit(start), F.lit(end + dt.timedelta(days=1))
    return None


def analysis_date_filter(df: DataFrame, date_range, start_date=None, end_date=None, as_of=None,
                         allowed: tuple[str, ...] = ALL_RANGES, column: str = "created_at") -> Column | None:
    """``date_range_filter`` on ``column``; when ``df`` is stored partitioned by the day of
    that column (``created_date``), the same bounds are also applied to the partition
    column, which is exact (``ts >= day`` iff ``date(ts) >= day``; ``ts < day`` iff
    ``date(ts) < day``) and lets the scan skip whole partitions."""
    pred = date_range_filter(column, date_range, start_date, end_date, as_of, allowed)
    if pred is None or PARTITION_COLUMN not in df.columns:
        return pred
    return pred & _within(F.col(PARTITION_COLUMN), *_day_bounds(date_range, start_date, end_date, as_of, allowed))


def agent_filter(agent_id: str | None, column: str = "agent_sender") -> Column | None:
    """Equality on the agent; unset, empty and ``'all'`` mean every agent."""
    if not agent_id or agent_id == "all":
        return None
    return F.col(column) == F.lit(str(agent_id))


def id_search(unique_id: str | None, column: str = "unique_id") -> Column | None:
    """Case-insensitive substring match; ``%`` and ``_`` typed by the user stay wildcards.

    A backslash escapes a wildcard or itself; before any other character it stands for
    nothing, as in the reference database (Spark would reject such a pattern).  One at the
    very end would escape the closing wildcard, so the text must end in ``%`` there.
    """
    if not unique_id or not unique_id.strip():
        return None
    pattern = re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], f"%{unique_id.strip()}%", flags=re.S)
    return F.col(column).ilike(pattern)


def status_filter(status: str | None, column: str = "review_status") -> Column | None:
    if not status:
        return None
    return F.col(column) == F.lit(status)


def where_all(df: DataFrame, *predicates: Column | None) -> DataFrame:
    kept = [p for p in predicates if p is not None]
    if not kept:
        return df
    return df.where(reduce(lambda a, b: a & b, kept))


def check_page(page: int, page_size: int, max_page_size: int) -> None:
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= max_page_size:
        raise ValueError(f"page_size must be between 1 and {max_page_size}")


def page_days(table: DataFrame, keys: DataFrame, ts_column: str) -> DataFrame:
    """Restrict a day-partitioned table to the days spanned by ``keys[ts_column]``.

    For fetching the rows of a bounded page: the bounds are one scalar subquery (reused
    for both ends), and a partition filter that contains a subquery is evaluated when
    the scan starts, so only the page's day partitions are listed and read.  Tables
    without the ``created_date`` partition column, or keys without the timestamp, are
    returned unchanged.
    """
    if PARTITION_COLUMN not in table.columns or ts_column not in keys.columns:
        return table
    bounds = keys.agg(
        F.struct(F.min(F.to_date(ts_column)).alias("lo"), F.max(F.to_date(ts_column)).alias("hi")).alias("b")
    ).scalar()
    day = F.col(PARTITION_COLUMN)
    return table.where(day.isNull() | ((day >= bounds["lo"]) & (day <= bounds["hi"])))


def call_days(calls: DataFrame, analyses: DataFrame) -> DataFrame:
    """The calls of the days that the given (date-filtered) analyses belong to.

    Where the analyses carry their call's day and the calls are stored by day, the days are one
    scalar subquery over the filtered analyses (a value per day of history, however many rows
    there are), evaluated when the scan of the calls starts: only those days' files are listed
    and read.  Calls without a time are always read.  Other layouts are returned unchanged.
    """
    if PARTITION_COLUMN not in calls.columns or CALL_DAY not in analyses.columns:
        return calls
    days = analyses.agg(F.collect_set(CALL_DAY).alias("days")).scalar()
    day = F.col(PARTITION_COLUMN)
    return calls.where(day.isNull() | F.array_contains(days, day))
