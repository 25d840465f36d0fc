"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.llm.common import gathered, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("c"), F.least("u", "low").alias("low"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("c"), "low")
    tied = down.join(least, F.col("u") == F.col("c"))
    return tied.select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))


def _shape(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes (0: all edges are stars) have two edges down or edges both up and down."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    row = per_node.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count(F.when(F.col("down") + F.col("up") > 1, 1))).first()
    return row[0], row[1]


def connected(edges: DataFrame, a: str = "a", b: str = "b", rows: int = 0) -> DataFrame:
    """node, root (the smallest node of its component) of every node that has an edge to another one.

    Each round combines minima before the shuffle and joins them back, so a node with very many neighbours is split like any skewed join.
    The rounds end when all edges are stars around their smallest node; their number grows with the logarithm of the longest path, and every
    round is written to the shared folder. `rows` is about how many edges to expect.
    """
    named = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = stage(gathered(named.distinct(), rows))
    while True:
        n, open_ = _shape(current)
        if not open_:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        current = stage(gathered(_small_star(_large_star(current)).where("u <> v").distinct(), n))
