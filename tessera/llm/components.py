"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """``node, root`` for every node of ``links(a, b)`` but the roots themselves; the root is the
    smallest node reachable. Second: the staged paths that the result reads.

    Minima are taken before the shuffle and staged, so that joining them back to a node
    with very many links is a plain shuffle join, whose large partitions Spark can split.
    No part of the graph comes to the driver but three counts a round."""
    paths: list[str] = []
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", paths)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mine: list[str] = []
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low", mine)
        large = stage(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", mine)
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), "low", mine)
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, paths = paths, []
        edges = stage(small.distinct(), "edges", paths)
        discard(links.sparkSession, old + mine)
        children = edges.groupBy("a").agg(F.count("*").alias("n"))
        forked = children.where("n > 1").limit(1).count()
        if not forked and not edges.join(children.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")), paths
