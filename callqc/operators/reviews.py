"""Review queues and review lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.functions.filters import agent_filter, status_filter, where_all
from callqc.plans import lookup
from callqc.plans.facts import (
    analysed_calls,
    analysis_call_keys,
    attach_payloads,
    attach_reviews,
    project_detail,
    reviewer_rows,
)
from callqc.sources.tables import Tables

def _oldest_first():
    return (F.col("call_created_at").asc_nulls_last(), F.col("id").asc_nulls_last())


def _newest_first():
    return (
        F.col("call_created_at").desc_nulls_first(),
        F.col("id").asc_nulls_last(),
        F.col("human_review_id").asc_nulls_first(),
    )


def _queue(t: Tables, agent_id, status) -> DataFrame:
    return where_all(analysed_calls(t), status_filter(status), agent_filter(agent_id))


def _queue_keys(t: Tables, status) -> DataFrame | None:
    """Calls of the analyses of a status (of every agent: a superset of the queue's calls)."""
    wanted = status_filter(status)
    return None if wanted is None else analysis_call_keys(t.conversation_analysis.where(wanted))


def pending_reviews(t: Tables, agent_id=None, status: str = "pending_review") -> DataFrame:
    """Analyses waiting for a review with their call columns, oldest call first."""
    rows = attach_payloads(_queue(t, agent_id, status), t, "conversation_id", keys=_queue_keys(t, status))
    return project_detail(rows.orderBy(*_oldest_first()), t, with_reviews=False)


def pending_reviews_total(t: Tables, agent_id=None, status: str = "pending_review") -> DataFrame:
    return _queue(t, agent_id, status).agg(F.count(F.lit(1)).alias("total"))


def completed_reviews(t: Tables, agent_id=None, status: str = "review_completed") -> DataFrame:
    """Reviewed analyses with review and reviewer, newest call first.

    The default status literal is the one the reference reads here; the submit path
    writes ``'completed'``, which callers can pass instead.
    """
    rows = attach_reviews(_queue(t, agent_id, status), t)
    rows = attach_payloads(rows, t, "conversation_id", keys=_queue_keys(t, status))
    return project_detail(rows.orderBy(*_newest_first()), t)


def completed_reviews_total(t: Tables, agent_id=None, status: str = "review_completed") -> DataFrame:
    """Number of rows of ``completed_reviews`` (a review fan-out counts every row).

    The reviewer join is left out: ``qc_users.id`` is that table's key, so it cannot
    change the number of rows.
    """
    reviews = t.conversation_review_human.selectExpr("analysis_id AS id")
    return _queue(t, agent_id, status).select("id").join(reviews, "id", "left").agg(F.count(F.lit(1)).alias("total"))


def review_by_analysis(t: Tables, analysis_ids=None) -> DataFrame:
    """``crh.*`` with the reviewer's name and username, for the given analyses (or all)."""
    crh = lookup.restrict(t.conversation_review_human, "analysis_id", analysis_ids)
    return crh.join(reviewer_rows(t), "reviewer_id", "left").select(*crh.columns, "reviewer_full_name",
                                                                    "reviewer_username")
