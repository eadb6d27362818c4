"""Scoring expressions: ratios, weights JSON, maximum possible score, page counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weight of each criterion when a weights object lacks the key.
DEFAULT_WEIGHTS = {
    "opening": 2,
    "listening": 12,
    "empathy": 10,
    "response_process": 15,
    "system_updation": 12,
    "closing": 4,
}
# The settings table stores these two criteria in camelCase.
SETTINGS_KEY = {
    "opening": "opening",
    "listening": "listening",
    "empathy": "empathy",
    "response_process": "responseProcess",
    "system_updation": "systemUpdation",
    "closing": "closing",
}
DEFAULT_MAX_SCORE_PER_METRIC = 4
WEIGHTS_SETTING = "weights"
MAX_SCORE_SETTING = "max_score_per_metric"


def count_if(predicate: Column) -> Column:
    """SUM(CASE WHEN p THEN 1 ELSE 0 END): 0 on rows, NULL only on an empty input."""
    return F.sum(F.when(predicate, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def json_number(json_text: Column, key: str) -> Column:
    """Numeric member of a flat JSON object; NULL when absent or not a number."""
    return F.get_json_object(json_text, f"$.{key}").try_cast("double")


def json_scalar_number(json_text: Column) -> Column:
    """A JSON document that is a bare number, e.g. ``'4'``."""
    return F.get_json_object(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "$.v").try_cast("double")


# Parsing a snapshot once into text fields keeps every member exactly as written (a
# number stays its digits, anything else its raw JSON), so try_cast then decides.
_SNAPSHOT_SCHEMA = "struct<" + ",".join(f"`{c}`:string" for c in DEFAULT_WEIGHTS) + ">"


def parse_snapshot(snapshot: Column) -> Column:
    """One JSON parse of a ``weights_snapshot`` into a struct of its six members (text).

    Project it as its own column before reading members with ``max_possible_score``:
    Spark then keeps the parse in a separate projection and evaluates it once per row,
    instead of once per member reference.
    """
    return F.from_json(snapshot, _SNAPSHOT_SCHEMA)


def max_possible_score(parsed: Column, max_score_per_metric: Column) -> Column:
    """max_score_per_metric * sum of the six weights (defaults for missing keys).

    ``parsed`` is a column holding ``parse_snapshot(weights_snapshot)``.
    """
    total = None
    for criterion, default in DEFAULT_WEIGHTS.items():
        w = F.coalesce(parsed[criterion].try_cast("double"), F.lit(float(default)))
        total = w if total is None else total + w
    return max_score_per_metric * total


def snapshot_present(snapshot: Column) -> Column:
    """True for a non-empty JSON object; NULL, ``{}`` and non-objects are absent."""
    return snapshot.isNotNull() & F.coalesce(F.size(F.json_object_keys(snapshot)) > 0, F.lit(False))


def page_count(total: Column, page_size: int) -> Column:
    """Integer ceiling of total / page_size (0 for an empty result), in exact integer steps."""
    bumped = total + F.lit(page_size - 1)
    return ((bumped - bumped % F.lit(page_size)) / F.lit(page_size)).cast("bigint")
