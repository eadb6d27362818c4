"""Scoring settings: current weights and the maximum score per metric.

Both read the key/value settings table, which holds a handful of rows; a global
aggregate turns "the row for this key, if any" into exactly one row, so an absent key
yields the defaults instead of an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.functions.scoring import (
    DEFAULT_MAX_SCORE_PER_METRIC,
    max_possible_score,
    snapshot_present,
    parse_snapshot,
    DEFAULT_WEIGHTS,
    MAX_SCORE_SETTING,
    SETTINGS_KEY,
    WEIGHTS_SETTING,
    json_number,
    json_scalar_number,
)
from callqc.sources.tables import Tables


def setting_value(t: Tables, key: str) -> DataFrame:
    """One row, one column ``setting_value`` (NULL when the key is absent)."""
    qs = t.qc_settings.where(F.col("setting_key") == F.lit(key))
    return qs.agg(F.max("setting_value").alias("setting_value"))


def weights(t: Tables) -> DataFrame:
    """The six weights in snake_case, read from the camelCase settings JSON with defaults."""
    v = F.col("setting_value")
    return setting_value(t, WEIGHTS_SETTING).select(
        *[
            F.coalesce(json_number(v, SETTINGS_KEY[c]), F.lit(float(d))).alias(c)
            for c, d in DEFAULT_WEIGHTS.items()
        ]
    )


def max_score(t: Tables) -> DataFrame:
    """``max_score_per_metric`` (default 4) as one row."""
    return setting_value(t, MAX_SCORE_SETTING).select(
        F.coalesce(json_scalar_number(F.col("setting_value")), F.lit(float(DEFAULT_MAX_SCORE_PER_METRIC))).alias(
            "max_score_per_metric"
        )
    )


def max_possible_scores(t: Tables) -> DataFrame:
    """Per analysis: whether its ``weights_snapshot`` is usable and the maximum possible
    overall score a new review of it would store (max score per metric x snapshot weights)."""
    ms = max_score(t).scalar()
    snap = F.col("weights_snapshot")
    parsed = t.conversation_analysis.select(
        "id", snapshot_present(snap).alias("weights_snapshot_present"), parse_snapshot(snap).alias("_w")
    )
    return parsed.select(
        "id",
        "weights_snapshot_present",
        F.when(F.col("weights_snapshot_present"), max_possible_score(F.col("_w"), ms)).alias(
            "max_possible_overall_score"
        ),
    )
