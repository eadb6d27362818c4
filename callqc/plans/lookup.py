"""Restricting a relation to a set of keys given in any form.

* ``None``            -- no restriction
* one value / a list  -- a literal IN list, pushed into the parquet scan (for the ids of a
                         request; pass a larger key set as a DataFrame)
* a DataFrame         -- a left semi join on its first column; Spark broadcasts the key
                         side only when its size is known to be under the threshold
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def restrict(df: DataFrame, column: str, keys) -> DataFrame:
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        k = keys.select(F.col(keys.columns[0]).alias("_key"))
        return df.join(k, F.col(column) == F.col("_key"), "left_semi")
    if isinstance(keys, (str, int)):
        keys = [keys]
    return df.where(F.col(column).isin(list(keys)))
