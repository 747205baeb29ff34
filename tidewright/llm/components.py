"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import durable

HOT_SHARE = 10_000


def _mark(edges: DataFrame) -> tuple:
    """Number of links and an order-free checksum of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """`edges` with the `m` of their node `u`; a node with many links is no hot spot.

    The nodes that hold 1/`HOT_SHARE` of the links or more, of which there can be only so many,
    are broadcast; only the links of the others are shuffled by node.
    """
    limit = max(edges.count() / HOT_SHARE, 2)
    hot = least.filter(F.col("n") >= limit).select("u", "m")
    marked = edges.join(F.broadcast(hot), "u", "left")
    cold = marked.filter(F.col("m").isNull()).drop("m").join(least.filter(F.col("n") < limit).select("u", "m"), "u")
    return marked.filter(F.col("m").isNotNull()).unionByName(cold)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    moved = _with_least(both, least).filter(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """`(node, component)` for each node that has a link; the component is its smallest node.

    Both halves of each round are written to the shared folder. The number of rounds grows with the
    logarithm of the longest path; minima are combined on the map side, and the links of nodes with
    many meet them by broadcast.
    """
    a, b = F.col(left), F.col(right)
    start = links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = durable(start)
    mark = _mark(edges)
    while mark[0]:
        edges = durable(_large_star(edges).distinct())
        edges = durable(_small_star(edges).distinct())
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
