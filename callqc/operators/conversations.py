"""Conversation listings: the analysed page, its totals, details, and the backlog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.functions.filters import (
    ALL_RANGES,
    agent_filter,
    analysis_date_filter,
    check_page,
    id_search,
    status_filter,
    where_all,
)
from callqc.plans import lookup
from callqc.plans.facts import (
    analysed_calls,
    analysis_call_keys,
    attach_payloads,
    attach_reviews,
    fetch_page,
    project_detail,
    review_keys,
    review_tally,
    windowed_calls,
)
from callqc.plans.paging import Keys, known_page_info, page_info, span_of_calls
from callqc.sources.tables import Tables

MAX_PAGE_SIZE = 10_000


def _head_order():
    # Newest call first (NULL times first, as a DESC sort in the reference database),
    # then the analysis id and the review id so that pages are stable.
    return (F.col("call_created_at").desc_nulls_first(), F.col("id").asc_nulls_last())


def _detail_order():
    return _head_order() + (F.col("human_review_id").asc_nulls_first(),)


def _filtered(t, agent_id, unique_id, date_range, start_date, end_date, status, as_of) -> DataFrame:
    window = analysis_date_filter(t.conversation_analysis, date_range, start_date, end_date, as_of, ALL_RANGES)
    f1 = windowed_calls(t.searched(unique_id), window, status_filter(status))
    return where_all(f1, agent_filter(agent_id), id_search(unique_id))


def _analyzed_keys(t: Tables, *filters) -> Keys:
    def source(span):
        own = span_of_calls(t, span)
        return review_keys(_filtered(own, *filters), own, ("id", "conversation_id", "call_created_at", "created_at"))

    def tally(span):
        own = span_of_calls(t, span)
        return review_tally(_filtered(own, *filters), own, "call_created_at")

    return Keys(source, "call_created_at", "id", _detail_order(), t.conversations_log, tally)


def analyzed_page(t: Tables, agent_id=None, unique_id=None, date_range=None, start_date=None, end_date=None,
                  status=None, page: int = 1, page_size: int = 100, as_of=None) -> DataFrame:
    """One page of analysed calls with their review, reviewer and payloads.

    Dates filter the analysis time; rows are shown and sorted by the call time.
    """
    check_page(page, page_size, MAX_PAGE_SIZE)
    keys = _analyzed_keys(t, agent_id, unique_id, date_range, start_date, end_date, status, as_of)
    return project_detail(fetch_page(keys.cut((page - 1) * page_size, page_size), t, _detail_order(), True), t)


def analyzed_page_and_info(t: Tables, agent_id=None, unique_id=None, date_range=None, start_date=None, end_date=None,
                           status=None, page: int = 1, page_size: int = 100, as_of=None) -> tuple[DataFrame, DataFrame]:
    """``analyzed_page`` and its ``analyzed_page_info`` from one count: both tell of the same rows, and
    the total costs no scan of its own."""
    check_page(page, page_size, MAX_PAGE_SIZE)
    keys = _analyzed_keys(t, agent_id, unique_id, date_range, start_date, end_date, status, as_of)
    found, total = keys.cut_and_total((page - 1) * page_size, page_size)
    rows = project_detail(fetch_page(found, t, _detail_order(), True), t)
    return rows, known_page_info(rows.sparkSession, total, page, page_size)


def analyzed_page_after(t: Tables, last, agent_id=None, unique_id=None, date_range=None, start_date=None, end_date=None,
                        status=None, page_size: int = 100, as_of=None) -> DataFrame:
    """The rows that follow ``last``, a row of an earlier page (its ``created_at``, ``id`` and
    ``human_review_id``): the next page at the same cost however deep it lies."""
    check_page(1, page_size, MAX_PAGE_SIZE)
    keys = _analyzed_keys(t, agent_id, unique_id, date_range, start_date, end_date, status, as_of)
    review = last["human_review_id"]
    tail = F.col("human_review_id").isNotNull() if review is None else F.col("human_review_id") > F.lit(review)
    return project_detail(fetch_page(keys.after(last["created_at"], last["id"], page_size, tail), t, _detail_order(), True), t)


def analyzed_page_info(t: Tables, agent_id=None, unique_id=None, date_range=None, start_date=None, end_date=None,
                       status=None, page: int = 1, page_size: int = 100, as_of=None) -> DataFrame:
    """total / page / page_size / total_pages, counted on F1 without the review join."""
    check_page(page, page_size, MAX_PAGE_SIZE)
    narrow = _filtered(t, agent_id, unique_id, date_range, start_date, end_date, status, as_of)
    return page_info(narrow, page, page_size)


def analyzed_detail(t: Tables, analysis_ids=None) -> DataFrame:
    """Full detail rows for the given analysis ids (one id, a list, or a DataFrame of ids)."""
    return project_detail(detail_rows(t, analysis_ids), t)


def detail_rows(t: Tables, analysis_ids=None) -> DataFrame:
    """F1 with reviews, then payloads (the widest data moves last), of the given analyses or all."""
    rows = attach_reviews(lookup.restrict(analysed_calls(t), "id", analysis_ids), t)
    keys = None
    if analysis_ids is not None:
        keys = analysis_call_keys(lookup.restrict(t.conversation_analysis.select("id", "conversation_id"), "id", analysis_ids))
    return attach_payloads(rows, t, "conversation_id", keys=keys)


UNANALYZED_COLUMNS = ("id", "created_at", "unique_id", "is_analyzed", "agent_sender")
def _unanalyzed_order():
    return (F.col("created_at").desc_nulls_first(), F.col("id").asc_nulls_last())


def _backlog(t: Tables, agent_id, unique_id) -> DataFrame:
    return where_all(t.searched(unique_id).calls, F.col("is_analyzed") == F.lit(False), agent_filter(agent_id), id_search(unique_id))


def _unanalyzed_keys(t: Tables, agent_id, unique_id) -> Keys:
    def source(span):
        return _backlog(span_of_calls(t, span), agent_id, unique_id).select(*UNANALYZED_COLUMNS)

    return Keys(source, "created_at", "id", _unanalyzed_order(), t.conversations_log)


def unanalyzed_page(t: Tables, agent_id=None, unique_id=None, page: int = 1, page_size: int = 100) -> DataFrame:
    """Calls not analysed yet (``is_analyzed`` false; NULL is not false), newest first."""
    check_page(page, page_size, MAX_PAGE_SIZE)
    return _unanalyzed_keys(t, agent_id, unique_id).cut((page - 1) * page_size, page_size)


def unanalyzed_page_after(t: Tables, last, agent_id=None, unique_id=None, page_size: int = 100) -> DataFrame:
    """The rows that follow ``last``, a row of an earlier page (its ``created_at`` and ``id``)."""
    check_page(1, page_size, MAX_PAGE_SIZE)
    return _unanalyzed_keys(t, agent_id, unique_id).after(last["created_at"], last["id"], page_size)


def unanalyzed_page_info(t: Tables, agent_id=None, unique_id=None, page: int = 1, page_size: int = 100) -> DataFrame:
    check_page(page, page_size, MAX_PAGE_SIZE)
    return page_info(_backlog(t, agent_id, unique_id), page, page_size)
