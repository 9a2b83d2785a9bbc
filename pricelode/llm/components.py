"""Distributed connected components by alternating large-star and small-star steps.

Every step replaces edges by as many or fewer that point to smaller nodes, until
each component is one star around its smallest node. A step joins edges with one
row per node, so a hub's edges can be split over tasks; nothing is collected.
"""

from pyspark.sql import functions as F

from .common import durable


def _star(edges, large):
    """One step; edges (u, v) with u > v, distinct."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        # Each larger neighbour v of u is tied to the least of u and its neighbours.
        step = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        # Each smaller neighbour of u, and u itself, is tied to the least of them.
        step = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return step.distinct()


def connected_components(edges):
    """edges: two columns u, v of one orderable type, in any order, repeated or not.

    Returns node, component (the smallest node reachable) for every node of an
    edge; edges with a null end or from a node to itself link nothing.
    An empty table gives an empty result. Nodes and edges at most halve the
    longest way to the smallest node in each round, so there are about as many
    rounds as the logarithm of the longest path. A hub's edges meet in one key of
    a join with one row per node, which Spark splits where it is skewed.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = durable(edges)
    mark = None
    while True:
        edges = durable(_star(_star(edges, True), False))
        # Two rounds that end with the same edges: all are stars.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    hubs = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)
