"""Machine-versus-human comparison: the reviewed page and per-criterion differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.functions.filters import ALL_RANGES, agent_filter, analysis_date_filter, check_page, status_filter, where_all
from callqc.operators.conversations import detail_rows
from callqc.plans.facts import (
    detail_columns,
    fetch_page,
    project_detail,
    review_keys,
    review_tally,
    select_names,
    windowed_calls,
)
from callqc.plans.paging import Keys, page_info, span_of_analyses
from callqc.sources.schemas import CRITERIA, HUMAN_SCORE_COLUMNS
from callqc.sources.tables import Tables

MAX_PAGE_SIZE = 500

# Newest analysis first: this listing sorts and shows the analysis time.
def _head_order():
    return (F.col("created_at").desc_nulls_first(), F.col("id").asc_nulls_last())


def _final_order():
    return _head_order() + (F.col("human_review_id").asc_nulls_first(),)

REVIEWED_COLUMNS = (
    ("id", "created_at")
    + tuple(f"{c}_score" for c in CRITERIA)
    + (
        "total_weighted_score",
        "final_percentage_score",
        "conversation_score_ai",
        "process_score_human",
        "other_criteria_score_human",
        "final_score_combined",
        "agent_sender",
        "unique_id",
    )
    + tuple(f"{c}_score_override" for c in CRITERIA)
    + HUMAN_SCORE_COLUMNS
    + ("reviewer_id", "reviewer_full_name", "reviewer_username")
)


def _reviewed(t, agent_id, date_range, start_date, end_date, as_of, status="completed") -> DataFrame:
    window = analysis_date_filter(t.conversation_analysis, date_range, start_date, end_date, as_of, ALL_RANGES)
    return where_all(windowed_calls(t, window, status_filter(status)), F.col("qc_status") == F.lit(status), agent_filter(agent_id))


def _reviewed_keys(t: Tables, *filters) -> Keys:
    def source(span):
        own = span_of_analyses(t, span)
        return review_keys(_reviewed(own, *filters), own, ("id", "conversation_id", "created_at", "call_created_at"))

    def tally(span):
        own = span_of_analyses(t, span)
        return review_tally(_reviewed(own, *filters), own, "created_at")

    return Keys(source, "created_at", "id", _final_order(), t.conversation_analysis, tally)


def reviewed_page(t: Tables, agent_id=None, date_range=None, start_date=None, end_date=None, page: int = 1,
                  page_size: int = 100, as_of=None) -> DataFrame:
    """Analyses completed on both status columns, newest analysis first, 29 columns."""
    check_page(page, page_size, MAX_PAGE_SIZE)
    keys = _reviewed_keys(t, agent_id, date_range, start_date, end_date, as_of)
    return select_names(fetch_page(keys.cut((page - 1) * page_size, page_size), t, _final_order(), False), REVIEWED_COLUMNS)


def reviewed_page_info(t: Tables, agent_id=None, date_range=None, start_date=None, end_date=None, page: int = 1,
                       page_size: int = 100, as_of=None) -> DataFrame:
    check_page(page, page_size, MAX_PAGE_SIZE)
    return page_info(_reviewed(t, agent_id, date_range, start_date, end_date, as_of), page, page_size)


def score_differences(t: Tables, analysis_ids=None) -> DataFrame:
    """Detail rows plus ``score_differences``: human minus machine per criterion.

    Present only where a review exists; inside it a NULL score counts as 0.
    """
    wide = detail_rows(t, analysis_ids)
    diff = F.struct(
        *[
            (F.coalesce(F.col(f"{c}_score_override"), F.lit(0.0)) - F.coalesce(F.col(f"{c}_score"), F.lit(0.0))).alias(c)
            for c in CRITERIA
        ]
    )
    out = project_detail(wide, t).withColumn(
        "score_differences", F.when(F.col("human_review_id").isNotNull(), diff)
    )
    return select_names(out, detail_columns(t) + ["score_differences"])
