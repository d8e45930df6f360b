"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and joins over the edges, so it runs on any
number of executors; nothing is collected.  Each round's edges are written, so
lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or not larger) neighbours of every node to the least of its neighbourhood."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = sides.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, where: str) -> DataFrame:
    """(node, component): the least node reachable from each node of ``edges(a, b)``.

    Nodes without an edge to another node have no row.  An empty input gives an
    empty result.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    now = save(edges.select("a", "b").where("a <> b").distinct(), where, "edges-0")
    before, k = None, 0
    while (mark := state(now)) != before and mark[0]:
        before, k = mark, k + 1
        now = save(_star(_star(now, True), False), where, f"edges-{k}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
