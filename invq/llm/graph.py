"""Connected components by alternating large and small stars, one shuffle a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    far = both.where("b > a").join(least, "a")
    return far.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node` and `label`, the least node of its component, for every node but the least ones.

    `edges` has columns a and b. A node's edges meet only in a minimum, combined before the shuffle,
    and in a join whose other side has one row a node, which Spark can split.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        now = written(_small_star(_large_star(now)), "stars")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = mark
