"""Connected components of a large graph by alternating large-star and small-star steps.

Each step is one grouped minimum and one equi-join, so a hub's edges are pre-aggregated in the one and
may be split by Spark in the other; the number of rounds grows with the logarithm of the largest
component. Edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two edges down, and none an edge down and one up: then each component is a star."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(edges: DataFrame) -> Written:
    """A written table (u, v): every node u of the edges (u, v), u > v, that is not the smallest node reachable
    from it, and that smallest node v.

    ``edges`` must be a written table, as it is read more than once. Without edges the result is empty.
    """
    now = None
    frame = edges.distinct()
    while True:
        after = Written(_small_star(_large_star(frame).distinct()).distinct(), "components", narrow=True)
        if now:
            now.drop()
        if _stars(after.df):
            return after
        now, frame = after, after.df
