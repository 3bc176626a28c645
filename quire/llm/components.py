"""Connected components of a graph of longs, by alternating large and small stars.

The work is joins and minima over edges; links are never gathered in one place. Each round
is a table in the shared folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, v) with the smallest v of each u beside it, as m."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    small = _lowest(large)
    return small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether every node has one parent, and no parent has a parent."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that isn't its component's smallest; root is that smallest node."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_done(now):
        now = written(_round(now), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
