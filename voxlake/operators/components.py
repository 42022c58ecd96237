"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.session import stash


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return near.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, the component being its least node. Edges go from the larger to the smaller
    end in every round; the rounds end when each node has one edge and each target none of its own."""
    pair = edges.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b"))
    pair = stash(pair.filter("a != b").distinct(), "components")
    for _ in range(rounds):
        if _stars(pair):
            break
        pair = stash(_small(_large(pair)), "components")
    else:
        raise RuntimeError("components did not settle")
    return pair.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pair.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(pair: DataFrame) -> bool:
    """No node has two smaller neighbours, and none is both an end and a centre."""
    ends = pair.groupBy("a").agg(F.count("*").alias("n"))
    twice = ends.filter("n > 1").limit(1)
    if twice.count():
        return False
    return not pair.select(F.col("b").alias("a")).distinct().join(ends, "a", "left_semi").limit(1).count()
