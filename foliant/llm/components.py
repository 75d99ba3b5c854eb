"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Every step is an aggregation with a map-side minimum and a join; each round is written to the
shared folder, which cuts the lineage. Nothing but two numbers of a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node reachable, for each node of an edge that is not the least itself.

    edges (u long, v long); loops and repeated edges count as nothing; no edge gives no row.
    """
    held, seen = written(edges.where("u <> v").select("u", "v").distinct(), name), None
    while True:
        held = written(_small_star(_large_star(held)), name)
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return held.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(now)
