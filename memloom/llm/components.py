"""Connected components of a table of links, without bringing any to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm._common import durable


def smallest_reachable(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node
    that it reaches.  Links are undirected; self-links are allowed; columns
    must be of one orderable type without nulls.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    each is a minimum over a node's neighbours, which is aggregated before the
    shuffle, and a join back, whose sides are plain exchanges that adaptive
    execution splits where a node has very many neighbours.  Every round is
    written to the shared folder.  Rounds grow with the logarithm of a
    component's size; an error is raised if ``rounds`` don't suffice.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour (and the node) to the smallest one
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours to the smallest of them
        large = durable(large.union(edges.filter("a = b")).distinct())
        lower = durable(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        joined = large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(lower, "u")
        small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").union(lower.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = durable(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components didn't settle")
    found = edges.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
