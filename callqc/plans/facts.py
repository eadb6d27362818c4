"""The two fact relations every listing and panel starts from.

F1 = conversation_analysis ⋈ conversations_log on ``conversation_id = id``.  Both are
large fact tables keyed by the call, so the join is an equi-join on a unique key: a
sort-merge (or shuffled-hash) join with no hot key, turned into a broadcast join by AQE
only when a filtered side is measured to be small.  Column names in F1:

* every analysis column under its own name (``id`` is the analysis id, ``created_at``
  the analysis time, which all date filters use);
* every call column except the payloads, with ``id`` as ``conversation_id`` (the join
  key, kept once), ``created_at`` as ``call_created_at`` and a storage partition column
  ``created_date`` as ``call_created_date``.

F2 = F1 ⟕ conversation_review_human (by analysis id) ⟕ qc_users (by reviewer id), with
the review id as ``human_review_id`` and the reviewer as ``reviewer_full_name`` /
``reviewer_username``.  Several reviews of one analysis fan out, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callqc.functions.filters import CALL_DAY, call_days, page_days, where_all
from callqc.sources.schemas import PAYLOAD_COLUMNS, REVIEW_VALUE_COLUMNS, SIGNAL_COLUMNS
from callqc.sources.tables import Tables

# cl columns shown by the detail listings, in their order (payloads are attached late).
CALL_DETAIL_COLUMNS = (
    "conversation_data",
    "agent_sender",
    "unique_id",
    "total_duration_seconds",
    "total_silence_seconds",
    "longest_silence_gap_seconds",
    "silence_percentage",
    "silence_timeline",
) + SIGNAL_COLUMNS

REVIEW_DETAIL_COLUMNS = ("human_review_id",) + REVIEW_VALUE_COLUMNS + ("reviewer_id",)
REVIEWER_COLUMNS = ("reviewer_full_name", "reviewer_username")


def q(name: str) -> str:
    """A column name quoted for SQL expression text."""
    return "`" + name.replace("`", "``") + "`"


def select_names(df: DataFrame, names) -> DataFrame:
    """``df.select(*names)`` in one JVM call (plain names, no expressions)."""
    return df.selectExpr(*[q(n) for n in names])


def _rename_calls(calls: DataFrame) -> DataFrame:
    """Call columns under their F1 names: the call id is the analyses' ``conversation_id``."""
    return calls.withColumnsRenamed(
        {"id": "conversation_id", "created_at": "call_created_at", "created_date": "call_created_date"}
    )


# Columns that the listings select after ``ca.*``: of equal names the later one is shown.
SHOWN_AFTER_ANALYSIS = frozenset(CALL_DETAIL_COLUMNS) | frozenset(REVIEW_DETAIL_COLUMNS) | frozenset(REVIEWER_COLUMNS)


def _sides(ca: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of F1 with every name on one of them only.

    A name that the analyses share with a column the listings show later (a call signal, a
    review value) is the later one; any other name they share with the calls is theirs.
    """
    ca = ca.drop(CALL_DAY, *[c for c in ca.columns if c in SHOWN_AFTER_ANALYSIS])
    cl = _rename_calls(calls)
    return ca, cl.drop(*[c for c in cl.columns if c in ca.columns and c != "conversation_id"])


def analysed_calls(t: Tables, window: DataFrame | None = None) -> DataFrame:
    """F1 (without payload columns), of all analyses or of a ``window``: date-filtered analyses,
    whose calls are then read from their own days only (``filters.call_days``)."""
    if window is None:
        ca, cl = _sides(t.conversation_analysis, t.calls)
    else:
        ca, cl = _sides(window, call_days(t.calls, window))
    return ca.join(cl, "conversation_id", "inner")


def windowed_calls(t: Tables, window: Column | None, *analysis_predicates: Column | None) -> DataFrame:
    """F1 of the analyses within a date ``window`` (None: all) that meet the other predicates, which
    are on analysis columns too."""
    ca = where_all(t.conversation_analysis, window, *analysis_predicates)
    if window is not None:
        return analysed_calls(t, ca)
    return analysed_calls(t.with_(conversation_analysis=ca))


def review_rows(t: Tables) -> DataFrame:
    """Review columns keyed by the analysis ``id``."""
    return t.conversation_review_human.selectExpr(
        "analysis_id AS id", "id AS human_review_id", *[q(c) for c in REVIEW_VALUE_COLUMNS], "reviewer_id"
    )


def reviewer_rows(t: Tables) -> DataFrame:
    """Reviewer name columns keyed by ``reviewer_id``."""
    return t.qc_users.selectExpr(
        "id AS reviewer_id", "full_name AS reviewer_full_name", "username AS reviewer_username"
    )


def attach_reviews(rows: DataFrame, t: Tables, rows_are_small: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """rows ⟕ reviews ⟕ reviewers; ``rows`` must carry the analysis ``id``.

    ``rows_are_small`` is set by callers whose row count is bounded by a validated
    parameter (a page).  The review table is then first reduced to the reviews of those
    rows by a left semi join against the broadcast row ids (the review table is only
    streamed, never shuffled), and the outer join runs between two small relations.
    An outer join cannot build its hash table on the preserved side, so broadcasting
    the rows directly into a left join is not possible.  ``ids`` (column ``id``) gives
    the key set from a narrower relation than ``rows`` when there is one.
    """
    reviews = review_rows(t)
    if rows_are_small:
        keys = (ids if ids is not None else rows).select("id")
        reviews = reviews.join(F.broadcast(keys), "id", "left_semi")
    # Reviewer names are joined to the (narrower) review rows before the reviews meet
    # the wide rows, so the wide rows are shuffled once, by analysis id.  The reviewer
    # dimension is joined by size: broadcast when Spark's upper-bound estimate or AQE's
    # measured size is under the threshold, sort-merge otherwise, where AQE splits a
    # reviewer holding a large share of the reviews.
    reviews = reviews.join(reviewer_rows(t), "reviewer_id", "left")
    return rows.join(reviews, "id", "left")


def fetch_analysed_calls(keys: DataFrame, t: Tables) -> DataFrame:
    """F1 rows for a bounded set of keys (``id``, ``conversation_id`` + extra columns).

    Both fact tables are streamed past broadcast keys, so only the page's rows ever
    leave their scan: the analyses by an inner join with the broadcast ids (extra key
    columns such as ``human_review_id`` ride along, duplicates keep multiplicity), the
    calls by a left semi join with the broadcast call ids.  ``call_keys(keys)`` is the
    same relation the payload fetch broadcasts, so Spark builds that broadcast once.
    On day-partitioned tables the scans also read only the page's days (``page_days``).
    """
    ca, cl = _sides(page_days(t.conversation_analysis, keys, "created_at"), page_days(t.calls, keys, "call_created_at"))
    extra = [c for c in keys.columns if c != "id" and c not in ca.columns and c not in cl.columns]
    ca_rows = ca.join(F.broadcast(keys.select("id", *extra)), "id", "inner")
    cl_rows = cl.join(F.broadcast(call_keys(keys).select("call_id")), F.col("conversation_id") == F.col("call_id"),
                      "left_semi")
    return ca_rows.join(cl_rows, "conversation_id", "inner")


def call_keys(keys: DataFrame) -> DataFrame:
    """The call ids of ``keys`` as ``call_id`` (with ``call_created_at`` when the keys
    carry it, so the payload fetch can read only the page's days)."""
    cols = [F.col("conversation_id").alias("call_id")]
    if "call_created_at" in keys.columns:
        cols.append(F.col("call_created_at"))
    return keys.select(*cols)


def attach_review_values(rows: DataFrame, t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Review values and reviewer for rows that already carry ``human_review_id``
    (a bounded page): one review row per page row, no further fan-out."""
    keys = (ids if ids is not None else rows).where(F.col("human_review_id").isNotNull()).select("human_review_id")
    values = t.conversation_review_human.selectExpr(
        "id AS human_review_id", *[q(c) for c in REVIEW_VALUE_COLUMNS], "reviewer_id"
    ).join(F.broadcast(keys), "human_review_id", "left_semi")
    return rows.join(values, "human_review_id", "left").join(reviewer_rows(t), "reviewer_id", "left")


def review_keys(narrow: DataFrame, t: Tables, key_columns) -> DataFrame:
    """``key_columns`` of a filtered F1 and the review id, after the review fan-out."""
    reviews = t.conversation_review_human.selectExpr("analysis_id AS id", "id AS human_review_id")
    return narrow.select(*key_columns).join(reviews, "id", "left")


def review_tally(narrow: DataFrame, t: Tables, time: str) -> DataFrame:
    """``time`` of a filtered F1 and ``_rows``, the rows of each analysis after the review fan-out."""
    reviews = t.conversation_review_human.groupBy(F.col("analysis_id").alias("id")).agg(F.count(F.lit(1)).alias("_rows"))
    return narrow.select("id", time).join(reviews, "id", "left").select(time, F.coalesce("_rows", F.lit(1)).alias("_rows"))


def fetch_page(page: DataFrame, t: Tables, final_order, with_payloads: bool) -> DataFrame:
    """The rows of a page's keys (``review_keys``) in ``final_order``: F2 [+ payloads].

    The wide columns are fetched by streaming each table past the broadcast page keys, as many
    as the page has rows.
    """
    rows = attach_review_values(fetch_analysed_calls(page, t), t, ids=page)
    if with_payloads:
        rows = attach_payloads(rows, t, "conversation_id", True, call_keys(page))
    return rows.orderBy(*final_order)


def attach_payloads(rows: DataFrame, t: Tables, call_id: str = "conversation_id", rows_are_small: bool = False,
                    keys: DataFrame | None = None) -> DataFrame:
    """Add ``conversation_data`` and ``silence_timeline`` to ``rows`` by call id.

    Without ``keys`` every payload is read and joined once.  With ``keys`` (``call_id``, from
    the narrowest relation that has the call ids, such as ``analysis_call_keys``) only the
    payloads of those calls are read and folded; with ``rows_are_small`` the keys are
    broadcast into that semi join.
    """
    payloads = t.payloads(keys, keys_are_small=rows_are_small).withColumnRenamed("call_id", call_id)
    return rows.join(payloads, call_id, "left")


def analysis_call_keys(analyses: DataFrame) -> DataFrame:
    """The call ids of restricted analyses as ``call_id``: the key side of a payload fetch
    that neither repeats the fact join nor reads the call table."""
    return analyses.select(F.col("conversation_id").alias("call_id"))


def analysis_star_columns(t: Tables) -> list[str]:
    """``ca.*`` without ``created_at`` (the listings show the call time under that name)
    and without the storage columns ``created_date`` and ``call_date``."""
    return [c for c in t.conversation_analysis.columns
            if c not in ("created_at", "created_date", CALL_DAY) and c not in SHOWN_AFTER_ANALYSIS]


def detail_columns(t: Tables, with_reviews: bool = True) -> list[str]:
    cols = analysis_star_columns(t) + list(CALL_DETAIL_COLUMNS)
    if with_reviews:
        cols += list(REVIEW_DETAIL_COLUMNS) + list(REVIEWER_COLUMNS)
    return cols + ["created_at"]


def project_detail(df: DataFrame, t: Tables, with_reviews: bool = True) -> DataFrame:
    """Final projection of the detail listings: ``ca.*``, call columns, review columns,
    and the call time as ``created_at`` (the later duplicate wins in the reference)."""
    out = df.drop("created_at").withColumnRenamed("call_created_at", "created_at")
    return select_names(out, detail_columns(t, with_reviews))


__all__ = [
    "PAYLOAD_COLUMNS",
    "analysed_calls",
    "windowed_calls",
    "attach_reviews",
    "attach_payloads",
    "project_detail",
    "detail_columns",
]
