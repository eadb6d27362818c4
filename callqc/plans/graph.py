"""Connected components as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.plans.stored import written


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected graph of long ids: ``node, rep`` for every node with a link.

    Each round maps a node to the neighbour (or itself) of the smallest hash and contracts
    the edges by that mapping, so the edges shrink by a constant factor and chains need a
    logarithmic number of rounds.  Every round is a grouped minimum (combined before the
    shuffle, so a node with very many links costs no single task) and two equi-joins, and
    is written to the shared folder.  Null ids and loops give no row.
    """
    order = F.xxhash64  # an order that has nothing to do with the ids
    e = written(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "cc-edges")
    steps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        step = (both.groupBy("u").agg(F.min(F.struct(order("v").alias("h"), F.col("v").alias("v"))).alias("m"))
                .select("u", F.least("m", F.struct(order("u").alias("h"), F.col("u").alias("v")))["v"].alias("p")))
        step = written(step, "cc-step")
        left = step.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = step.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        e = written(
            e.join(left, "a").join(right, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        steps.append(step)
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("rep"))
    out = steps[0].select(F.col("u").alias("node"), F.col("p").alias("rep"))
    for step in steps[1:]:
        out = (out.join(step.select(F.col("u").alias("rep"), "p"), "rep", "left")
               .select("node", F.coalesce("p", "rep").alias("rep")))
    return written(out, "cc-nodes")
