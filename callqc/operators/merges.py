"""Batch merges: review submissions, status updates, user and setting changes.

The reference applies one change per request.  Here a change feed (ordered by ``seq``)
is merged into the current tables in one job, giving the state the requests would have
left behind when applied in ``seq`` order.  Each merge is a handful of equi-joins and
partial aggregations keyed by the changed entity; no window holds a whole key group, so
an entity that receives a third of the feed is folded map-side before any shuffle.
Outputs are new DataFrames; callers write them to a new table version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callqc.functions.filters import CALL_DAY, call_days
from callqc.functions.scoring import SETTINGS_KEY, max_possible_score, snapshot_present, parse_snapshot
from callqc.operators.settings import max_score
from callqc.operators.user_changes import apply_user_changes  # noqa: F401 - offered here with the other merges
from callqc.plans.facts import q
from callqc.sources.schemas import REVIEW_VALUE_COLUMNS
from callqc.sources.tables import Tables

SUBMISSION_VALUES = ("reviewer_id",) + REVIEW_VALUE_COLUMNS
COMPLETED = "completed"


def _latest(df: DataFrame, key: str, order: str, values) -> DataFrame:
    """The row with the highest ``order`` per ``key``.

    ``max`` of a struct led by ``order`` aggregates partially (map-side) like any max,
    and breaks ties on ``order`` by the values, so a repeated sequence number still
    gives one deterministic winner.
    """
    best = df.groupBy(key).agg(F.max(F.struct(order, *values)).alias("_latest"))
    return best.select(key, "_latest.*")


@dataclass(frozen=True)
class ReviewMerge:
    reviews: DataFrame  # the new conversation_review_human
    changed: DataFrame  # its updated and inserted rows alone
    actions: DataFrame  # per analysis in the feed: analysis_id, seq, action, reason

    @property
    def accepted(self) -> DataFrame:
        return self.actions.where(F.col("action") != "reject").select("analysis_id")

    @property
    def rejected(self) -> DataFrame:
        return self.actions.where(F.col("action") == "reject").select("analysis_id", "seq", "reason")


def default_review_id(analysis_id: Column) -> Column:
    """Deterministic id of a new review, so a recomputed task produces the same id."""
    return F.concat(F.lit("review-"), analysis_id.cast("string"))


def submit_reviews(
    t: Tables,
    submissions: DataFrame,
    new_review_id: Callable[[Column], Column] = default_review_id,
) -> ReviewMerge:
    """Merge review submissions into conversation_review_human.

    Per analysis the last submission (highest ``seq``) decides:

    * a review exists -> ``update``: reviewer and the 18 review values are overwritten,
      id, weights_snapshot and max_possible_overall_score are kept;
    * otherwise, the analysis has a non-empty ``weights_snapshot`` -> ``insert`` with a
      copy of the snapshot and max_score_per_metric x (sum of its weights);
    * otherwise -> ``reject`` (``analysis_not_found`` / ``weights_snapshot_missing``),
      nothing is written for it.
    """
    crh = t.conversation_review_human
    last = _latest(submissions, "analysis_id", "seq", SUBMISSION_VALUES)
    # only reviews of the submitted analyses are looked at
    reviewed = (crh.select("analysis_id").join(last.select("analysis_id"), "analysis_id", "left_semi").distinct()
                .withColumn("_has_review", F.lit(True)))
    analyses = t.conversation_analysis.select(
        F.col("id").alias("analysis_id"), F.col("weights_snapshot").alias("_snapshot"), F.lit(True).alias("_has_analysis")
    )
    decided = last.join(reviewed, "analysis_id", "left").join(analyses, "analysis_id", "left")
    action = (
        F.when(F.col("_has_review"), F.lit("update"))
        .when(snapshot_present(F.col("_snapshot")), F.lit("insert"))
        .otherwise(F.lit("reject"))
    )
    reason = F.when(
        action == "reject",
        F.when(F.col("_has_analysis").isNull(), F.lit("analysis_not_found")).otherwise(F.lit("weights_snapshot_missing")),
    )
    decided = decided.withColumn("action", action).withColumn("reason", reason)

    types = {f.name: f.dataType.simpleString() for f in crh.schema.fields}
    updates = decided.where(F.col("action") == "update").selectExpr(
        "analysis_id", *[f"{q(c)} AS {q('_new_' + c)}" for c in SUBMISSION_VALUES], "true AS _upd"
    )
    def update(rows: DataFrame, how: str) -> DataFrame:
        return rows.join(updates, "analysis_id", how).selectExpr(
            *[f"CASE WHEN _upd THEN CAST({q('_new_' + c)} AS {types[c]}) ELSE {q(c)} END AS {q(c)}" if c in SUBMISSION_VALUES else q(c)
              for c in crh.columns])

    ms = max_score(t).scalar()  # one value, evaluated once as a scalar subquery
    to_insert = decided.where(F.col("action") == "insert").withColumn("_w", parse_snapshot(F.col("_snapshot")))
    inserts = to_insert.select(
        new_review_id(F.col("analysis_id")).cast(types["id"]).alias("id"),
        F.expr(f"CAST(analysis_id AS {types['analysis_id']}) AS analysis_id"),
        *[F.expr(f"CAST({q(c)} AS {types[c]}) AS {q(c)}") for c in SUBMISSION_VALUES],
        F.expr("_snapshot AS weights_snapshot"),
        max_possible_score(F.col("_w"), ms).alias("max_possible_overall_score"),
    )
    inserts = inserts.select(*crh.columns)
    reviews, changed = (update(crh, how).unionByName(inserts) for how in ("left", "inner"))
    return ReviewMerge(reviews, changed, decided.select("analysis_id", "seq", "action", "reason"))


def status_changes(t: Tables, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed rows alone: (analysis ``id, conversation_id, created_at, review_status``,
    call ``id, created_at, qc_status``) of accepted submissions that are not completed already.

    Narrow key columns only, whatever the tables hold; ``sources.updates`` rewrites the touched
    days with them, and a sink with MERGE may take them as its source.
    """
    acc = accepted.select(F.col(accepted.columns[0]).alias("_acc_id")).distinct()
    shown = ["id", "conversation_id", "created_at", "review_status", *({CALL_DAY} & set(t.conversation_analysis.columns))]
    touched = t.conversation_analysis.select(*shown).join(acc, F.col("id") == F.col("_acc_id"), "left_semi")
    analyses = (touched.where(~F.col("review_status").eqNullSafe(F.lit(COMPLETED)))
                .withColumn("review_status", F.lit(COMPLETED)).drop(CALL_DAY))
    # stored by day, only the days of the touched analyses' calls are read
    calls = (call_days(t.calls, touched).select("id", "created_at", "qc_status").where(~F.col("qc_status").eqNullSafe(F.lit(COMPLETED)))
             .join(touched.select(F.col("conversation_id").alias("_cid")), F.col("id") == F.col("_cid"), "left_semi")
             .withColumn("qc_status", F.lit(COMPLETED)))
    return analyses, calls


def review_status_updates(t: Tables, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (conversation_analysis, conversations_log) after accepted submissions.

    ``review_status`` of each accepted analysis and ``qc_status`` of its call become
    ``'completed'``; an accepted id without an analysis row changes nothing.
    """
    ca, cl = t.conversation_analysis, t.conversations_log
    acc = accepted.select(F.col(accepted.columns[0]).alias("_acc_id")).distinct().withColumn("_hit", F.lit(True))
    new_ca = ca.join(acc, F.col("id") == F.col("_acc_id"), "left").select(
        *[
            F.when(F.col("_hit"), F.lit(COMPLETED)).otherwise(F.col(c)).alias(c) if c == "review_status" else F.col(c)
            for c in ca.columns
        ]
    )
    calls = (
        ca.join(acc, F.col("id") == F.col("_acc_id"), "left_semi")
        .select(F.col("conversation_id").alias("_cid"))
        .distinct()
        .withColumn("_chit", F.lit(True))
    )
    new_cl = cl.join(calls, F.col("id") == F.col("_cid"), "left").select(
        *[
            F.when(F.col("_chit"), F.lit(COMPLETED)).otherwise(F.col(c)).alias(c) if c == "qc_status" else F.col(c)
            for c in cl.columns
        ]
    )
    return new_ca, new_cl


def weights_setting_value(opening, listening, empathy, response_process, system_updation, closing) -> Column:
    """JSON text of a weights setting, stored with the settings table's camelCase keys."""
    values = dict(
        opening=opening, listening=listening, empathy=empathy, response_process=response_process,
        system_updation=system_updation, closing=closing,
    )
    return F.to_json(
        F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(SETTINGS_KEY[k])
                   for k, v in values.items()])
    )


def apply_setting_changes(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite value, updated_by and updated_at of existing keys with their last change.

    Changes to keys the table does not have change nothing.
    """
    if "updated_at" not in settings.columns:
        settings = settings.withColumn("updated_at", F.lit(None).cast(T.TimestampNTZType()))
    if "updated_by" not in settings.columns:
        settings = settings.withColumn("updated_by", F.lit(None).cast("string"))
    has_ts = "updated_at" in changes.columns
    cols = ["setting_value", "updated_by"] + (["updated_at"] if has_ts else [])
    last = _latest(changes, "setting_key", "seq", cols)
    last = last.select(
        "setting_key",
        F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_new_{c}") for c in cols],
    )
    out = settings.join(last, "setting_key", "left")

    def pick(c):
        if c == "updated_at" and not has_ts:
            new = F.localtimestamp()
        else:
            new = F.col(f"_new_{c}")
        return F.when(F.col("_hit"), new.cast(settings.schema[c].dataType)).otherwise(F.col(c)).alias(c)

    return out.select(*[pick(c) if c in ("setting_value", "updated_by", "updated_at") else F.col(c) for c in settings.columns])
