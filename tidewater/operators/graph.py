"""Cycles of a waits-for graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def on_cycle(edges: DataFrame, waiter: str, holder: str) -> DataFrame:
    """(node) of the nodes that can reach themselves.

    The closure doubles its path length in each round, so rounds are the
    logarithm of the longest path; they end when no pair is added.  Lock graphs
    are small; the closure has a row for each reachable pair.
    """
    reach = cut(edges.select(F.col(waiter).alias("a"), F.col(holder).alias("b")).dropna().distinct())
    size = reach.count()
    while True:
        step = reach.alias("x").join(reach.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        reach = cut(reach.union(step).distinct())
        if (grown := reach.count()) == size:
            return reach.where("a = b").select(F.col("a").alias("node"))
        size = grown
