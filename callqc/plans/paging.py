"""Pages (ORDER BY a time, newest first, LIMIT n OFFSET m), their totals, and keyset pages.

A page is found by order statistics.  The filtered keys are counted per hour of the sort time; the
hours that hold the page become a time span, which is pushed into the scan of the table that
has the time, so the keys of those hours alone are joined again.  Hours of more than
``MAX_SORT`` rows are counted by second, millisecond and microsecond, and rows of one and the same
time by ranges of their id, until what is left can be sorted at once; a bulk load that puts a
third of all rows on one time is sorted like any other page.  Where the time's table is stored by
day, the counts start at the newest days and go back (twice as far each time) only until the
page is covered.

The driver gets counts (a row per hour of history at most) and the page's own keys (as many as
the page has rows); the wide columns are then fetched for those keys (``facts.review_page``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callqc.functions.filters import CALL_DAY, PARTITION_COLUMN
from callqc.functions.scoring import page_count

#: Rows that are sorted at once, and ids that a split of equal times goes by.
MAX_SORT, SPLITS = 1_000_000, 64
_UNITS = (("HOUR", dt.timedelta(hours=1)), ("SECOND", dt.timedelta(seconds=1)),
          ("MILLISECOND", dt.timedelta(milliseconds=1)), ("MICROSECOND", dt.timedelta(microseconds=1)))


@dataclass(frozen=True)
class Span:
    """Times ``low <= t < high`` (None: no such times), with or without rows that have no time."""

    low: dt.datetime | None
    high: dt.datetime | None
    nulls: bool

    def holds(self, column: str) -> Column:
        c = F.col(column)
        inside = F.lit(False) if self.low is None else (c >= _time(self.low)) & (c < _time(self.high))
        return inside | c.isNull() if self.nulls else inside

    def of(self, df: DataFrame, column: str, day: str | None = None) -> DataFrame:
        """The rows whose time is in the span; ``day`` is a column with the day of that time."""
        kept = df if column not in df.columns else df.where(self.holds(column))
        if day is None or day not in df.columns:
            return kept
        d = F.col(day)
        inside = F.lit(False) if self.low is None else (d >= F.lit(self.low.date())) & (d <= F.lit((self.high - dt.timedelta(microseconds=1)).date()))
        return kept.where(inside | d.isNull() if self.nulls else inside)


def _time(value: dt.datetime) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


#: Keys whose sort time is in a span (None: all keys).
Source = Callable[[Span | None], DataFrame]


@dataclass(frozen=True)
class Keys:
    """The keys of a listing: where they come from and how they are sorted.

    ``order`` is a total order led by the column ``time``, newest first and NULL before all, then by
    ``key`` ascending.  ``stored`` is the table that has the time; its days are used if it is stored by day.
    ``tally``, if given, is a cheaper source for counts: a row per listed analysis with ``_rows``, its rows
    in the listing (by its reviews).
    """

    source: Source
    time: str
    key: str
    order: Sequence[Column]
    stored: DataFrame | None = None
    tally: Source | None = None

    def _counts(self, span: Span | None, unit: str) -> list[tuple[dt.datetime | None, int]]:
        return self._tallied(span, unit)[0]

    def _tallied(self, span: Span | None, unit: str) -> tuple[list[tuple[dt.datetime | None, int]], int]:
        """Rows per unit of time, newest first, and the number of listed analyses."""
        bucket = F.date_trunc(unit, self.time).cast("timestamp_ntz")
        rows = self.tally(span) if self.tally else self.source(span).withColumn("_rows", F.lit(1))
        counted = rows.groupBy(bucket.alias("b")).agg(F.sum("_rows").alias("n"), F.count(F.lit(1)).alias("listed")).collect()
        pairs = sorted(((r.b, r.n) for r in counted), key=lambda r: (r[0] is not None, r[0] and dt.datetime.max - r[0]))
        return pairs, sum(r.listed for r in counted)

    def _newest(self, rows: int) -> list[tuple[dt.datetime | None, int]]:
        """Counts per hour, newest first, of all keys or of enough days to cover ``rows``."""
        if self.stored is None or PARTITION_COLUMN not in self.stored.columns:
            return self._counts(None, "HOUR")
        days = {r[0]: r[1] for r in self.stored.groupBy(PARTITION_COLUMN).count().collect()}  # reads no column
        timed = sorted((d for d in days if d is not None), reverse=True)
        found = self._counts(Span(None, None, True), "HOUR") if None in days else []
        goal = rows
        while timed and sum(n for _, n in found) < rows:
            taken, held = [], 0
            while timed and held < goal:
                taken.append(timed.pop(0))
                held += days[taken[-1]]
            goal *= 2
            low, high = (dt.datetime.combine(d, dt.time()) for d in (taken[-1], taken[0]))
            found += self._counts(Span(low, high + dt.timedelta(days=1), False), "HOUR")
        return found

    def cut_and_total(self, offset: int, limit: int) -> tuple[DataFrame, int]:
        """The page's keys, and the number of listed analyses from the very counts that found them."""
        counted, total = self._tallied(None, "HOUR")
        return self.cut(offset, limit, counted), total

    def cut(self, offset: int, limit: int, counted: list[tuple[dt.datetime | None, int]] | None = None) -> DataFrame:
        """Rows ``offset + 1 .. offset + limit`` in ``order``: the page's keys, held by the driver."""
        counted, before, span = counted or self._newest(offset + limit), 0, None
        for level, (unit, width) in enumerate(_UNITS):
            if level:
                counted = self._counts(span, unit)
            chosen: list[tuple[dt.datetime | None, int, int]] = []
            for b, n in counted:
                if before + n > offset and before < offset + limit:
                    chosen.append((b, n, before))
                before += n
            if not chosen:
                return _local(self.source(Span(None, None, False)), [])
            before = chosen[0][2]
            times = [b for b, *_ in chosen if b is not None]
            span = Span(min(times, default=None), max(times) + width if times else None, chosen[0][0] is None)
            if sum(n for _, n, _ in chosen) <= MAX_SORT:
                break
        rows = self.source(span)
        for b, n, first in {chosen[0], chosen[-1]}:
            if n > MAX_SORT:  # equal times: only the outermost can be that many
                near, skipped = self._id_range(b, offset - first, offset + limit - first, n)
                rows = rows.where(near | ~F.col(self.time).eqNullSafe(F.lit(None) if b is None else _time(b)))
                before += skipped if b == chosen[0][0] else 0
        page = rows.orderBy(*self.order).offset(offset - before).limit(limit)
        return _local(rows, page.collect())

    def _id_range(self, time: dt.datetime | None, first: int, last: int, n: int) -> tuple[Column, int]:
        """A range of the key that holds positions ``first .. last`` among the rows of one time, and
        how many rows of that time come before it."""
        at_time = Span(None, None, True) if time is None else Span(time, time + dt.timedelta(microseconds=1), False)
        key, near, skipped = F.col(self.key), F.lit(True), 0
        while n > MAX_SORT:
            rows = self.source(at_time).where(near).select(key)
            drawn = rows.distinct().orderBy(F.xxhash64(key)).limit(SPLITS)
            at = [r[0] for r in drawn.orderBy(key).collect()][1:]
            if not at:
                break
            place = F.size(F.filter(F.array(*map(F.lit, at)), lambda x: x <= key))
            counted = sorted(rows.groupBy(place.alias("b")).count().collect())
            chosen, before = [], skipped
            for b, size in counted:
                if before + size > first and before < last:
                    chosen.append((b, size, before))
                before += size
            low, high = chosen[0][0], chosen[-1][0]
            near = near & (key >= F.lit(at[low - 1]) if low else F.lit(True)) & (key < F.lit(at[high]) if high < len(at) else F.lit(True))
            skipped, left = chosen[0][2], sum(size for _, size, _ in chosen)
            if left == n:
                break
            n = left
        return near, skipped

    def after(self, time: dt.datetime | None, key, limit: int, tail: Column | None = None) -> DataFrame:
        """The first ``limit`` rows after the row of that time and key (keyset paging).

        The cost does not depend on how deep the page lies: a task keeps ``limit`` rows, and the
        time bounds the scan.  ``tail`` says which rows of the same time and key come later.
        """
        same = F.col(self.time).eqNullSafe(F.lit(None) if time is None else _time(time))
        further = F.col(self.key) > F.lit(key)
        further = further | ((F.col(self.key) == F.lit(key)) & tail) if tail is not None else further
        if time is None:
            rows = self.source(None).where((same & further) | F.col(self.time).isNotNull())
        else:
            rows = self.source(Span(dt.datetime.min, time + dt.timedelta(microseconds=1), False)).where(~same | further)
        return _local(rows, rows.orderBy(*self.order).limit(limit).collect())


def _local(like: DataFrame, rows: list) -> DataFrame:
    return like.sparkSession.createDataFrame([tuple(r) for r in rows], like.schema)


def span_of_calls(t, span: Span | None):
    """Tables whose calls have their time in the span (and analyses of calls of those days)."""
    if span is None:
        return t
    return t.with_(conversations_log=span.of(t.conversations_log, "created_at", PARTITION_COLUMN),
                   conversation_analysis=replace(span, nulls=True).of(t.conversation_analysis, "", CALL_DAY))


def span_of_analyses(t, span: Span | None):
    """Tables whose analyses have their time in the span."""
    return t if span is None else t.with_(conversation_analysis=span.of(t.conversation_analysis, "created_at", PARTITION_COLUMN))


def page_info(filtered: DataFrame, page: int, page_size: int) -> DataFrame:
    """One row: total, page, page_size, total_pages."""
    return _info(filtered.agg(F.count(F.lit(1)).alias("total")), page, page_size)


def known_page_info(spark: SparkSession, total: int, page: int, page_size: int) -> DataFrame:
    """``page_info`` of a total that is known already."""
    return _info(spark.range(1).select(F.lit(total).cast("bigint").alias("total")), page, page_size)


def _info(total: DataFrame, page: int, page_size: int) -> DataFrame:
    return total.select(
        "total",
        F.lit(page).cast("bigint").alias("page"),
        F.lit(page_size).cast("bigint").alias("page_size"),
        page_count(F.col("total"), page_size).alias("total_pages"),
    )
