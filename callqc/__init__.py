"""Call-quality analytics on Spark.

Pure functions from Spark DataFrames (and plain parameters) to DataFrames.
Sub-packages:

* ``sources``   -- table schemas, loaders (parquet / JDBC / derived fixtures), sinks, updates
* ``functions`` -- Column builders: filters, scoring and JSON helpers, page arithmetic
* ``plans``     -- shared plan fragments: the fact joins, pages, key lookups, ranking
* ``operators`` -- the user-level queries and the batch merges
"""

from callqc.sources.tables import Tables  # noqa: F401

__all__ = ["Tables"]
