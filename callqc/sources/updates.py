"""In-place updates of stored tables that rewrite only the parts their rows lie in.

A stored table is partitioned (facts by day, reviews by a hash of their analysis).  Changed rows
name their parts; those parts alone are read, joined with the changes, written to the shared
folder and then put in place of the old ones (dynamic partition overwrite), so the cost follows the
touched parts and every other file stays as it is.  An update that is lost on its way can be
sent again: the same changes leave the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callqc.functions.filters import PARTITION_COLUMN
from callqc.operators.merges import ReviewMerge, status_changes
from callqc.plans.facts import q
from callqc.plans.stored import written
from callqc.sources.sinks import REVIEW_PART, review_part
from callqc.sources.tables import Tables


def rewrite_parts(spark: SparkSession, path: str, part: str, key: str, changes: DataFrame, insert: bool = False) -> int:
    """Replace, in the parts that ``changes`` names, the columns that it has, row by row; returns the
    number of parts rewritten.

    ``changes`` has ``key`` and ``part`` (null is a part too), one row for each key, and any columns
    of the table.  Keys that the table does not have in that part change nothing, or become rows
    with ``insert``.
    """
    table = spark.read.parquet(path)
    new = [c for c in changes.columns if c not in (key, part)]
    missing = set(new) - set(table.columns)
    if missing:
        raise ValueError(f"the table has no {', '.join(sorted(missing))}")
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    sent = written(changes.selectExpr(f"{q(key)} AS _key", f"CAST({q(part)} AS {kinds[part]}) AS _part", "true AS _hit",
                                      *(f"CAST({q(c)} AS {kinds[c]}) AS {q('_new_' + c)}" for c in new)), "changes")
    touched = [r[0] for r in sent.select("_part").distinct().collect()]  # at most the table's parts
    if not touched:
        return 0
    named = [v for v in touched if v is not None]
    inside = F.col(part).isin(named) if named else F.lit(False)
    old = table.where(inside | F.col(part).isNull() if None in touched else inside)
    same = (F.col(key) == F.col("_key")) & F.col(part).eqNullSafe(F.col("_part"))
    replaced = (F.expr(f"CASE WHEN _hit THEN {q('_new_' + c)} ELSE {q(c)} END AS {q(c)}") if c in new else F.col(q(c)) for c in table.columns)
    rows = old.join(sent, same, "left").select(*replaced)
    if insert:
        unseen = sent.join(old.select(key, part), same, "left_anti")
        rows = rows.unionByName(unseen.select(F.col("_key").cast(kinds[key]).alias(key), F.col("_part").alias(part), *(F.col(f"_new_{c}").alias(c) for c in new)),
                                allowMissingColumns=True)
    staged = written(rows, "parts").hint("rebalance", part)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return len(touched)


def apply_reviews(spark: SparkSession, base: str, t: Tables, merge: ReviewMerge) -> dict[str, int]:
    """Bring the tables stored at ``base`` (``sinks.write_tables``; ``t`` is their present state) up to
    date with merged submissions: the reviews written, and both statuses of what was accepted.
    Returns the number of parts rewritten by table."""
    analyses, calls = status_changes(t, merge.accepted)
    day = F.to_date("created_at").alias(PARTITION_COLUMN)
    # everything is worked out before the first table changes
    reviews = written(merge.changed.withColumn(REVIEW_PART, review_part(F.col("analysis_id"))), "reviews")
    analyses = written(analyses.select("id", day, "review_status"), "analyses")
    calls = written(calls.select("id", day, "qc_status"), "calls")
    return {
        "conversation_review_human": rewrite_parts(spark, f"{base}/conversation_review_human", REVIEW_PART, "id", reviews, insert=True),
        "conversation_analysis": rewrite_parts(spark, f"{base}/conversation_analysis", PARTITION_COLUMN, "id", analyses),
        "conversations_log": rewrite_parts(spark, f"{base}/conversations_log", PARTITION_COLUMN, "id", calls),
    }
