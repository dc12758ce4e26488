"""Connected components over an edge table, on executors only.

Alternating large-star and small-star steps: every step rewrites the edges so that nodes point at
the smallest neighbour known so far, until every component is a star around its smallest node. The
number of steps grows with the logarithm of the longest chain. Edges and labels never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v); a partial minimum comes before the shuffle."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = both.join(least, "u")
    if large:
        out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node points at one other and none is both pointed at and pointing."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, max_steps: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): component is the smallest reachable node.

    Nodes without an edge are not returned. Null ends and loops are ignored; repeated edges count
    once; an empty edge table gives an empty result.
    """
    now = scratch.save(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    for _ in range(max_steps):
        if _is_stars(now):
            break
        then = scratch.save(_star(_star(now, large=True), large=False), "edges")
        scratch.drop(now)
        now = then
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
