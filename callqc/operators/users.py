"""Panel users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.sources.tables import Tables


def users_list(t: Tables) -> DataFrame:
    """Users without credentials, newest first; ``created_at`` as text
    (``yyyy-MM-dd HH:mm:ss[.ffffff]``, trailing zeros of the fraction dropped)."""
    qu = t.qc_users
    return qu.select(
        "id", "username", "full_name", "role", "is_active", F.col("created_at").cast("string").alias("created_at"),
        F.col("created_at").alias("_ts"),
    ).orderBy(F.col("_ts").desc_nulls_first(), F.col("id").asc_nulls_last()).drop("_ts")
