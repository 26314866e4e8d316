"""Connected components by alternating large-star and small-star steps.

A step takes each end's smallest neighbour by an aggregate, which is combined
before it is shuffled, and joins it with the edges; adaptive execution splits the
join where one end has very many.  Lineage is cut in the shared checkpoint
folder after each round.  The number of rounds grows with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def _low(edges: DataFrame, column) -> DataFrame:
    """The edges with m, the smallest of ``column`` among those with the same u."""
    least = edges.groupBy(F.col("u").alias("x")).agg(F.min(column).alias("m"))
    return edges.join(least, F.col("u") == F.col("x")).drop("x")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _low(both, F.least("u", "v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    pair = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return _low(down, F.col("v")).select(F.explode(pair).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id that an edge (a, b) touches, but for the roots themselves.

    The root is the component's smallest id.  Loops, repeated and reversed edges
    count once; edges with a null end are dropped.
    """
    now = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).dropna().where("u <> v").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = mark
        now = cut(_small(_large(now)))
