"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import keep, stage, staging, unstage


def lowest_reachable(links: DataFrame) -> DataFrame:
    """(v, root) for the vertices of ``links`` (columns ``a``, ``b``) that reach a lower one: the lowest. Roots have no row.

    Every round links each vertex to the lowest of its neighbourhood, first from its larger neighbours, then
    from its smaller ones; links turn into stars around the lowest vertices in a logarithmic number of rounds.
    Rounds are written to the shared folder. A hub's neighbours are joined, never gathered; null ends and loops
    are ignored, an empty table gives an empty result.
    """
    spark = links.sparkSession
    with staging(spark):
        edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        while not _stars(edges):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
            large = both.join(low, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = stage(large.distinct(), "large")
            low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), "m")
            small = large.join(low, F.col("a") == F.col("_a"))
            small = small.select("a", F.col("m").alias("b")).unionByName(
                small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            following = stage(small.distinct(), "links")
            unstage(large)
            unstage(edges)
            edges = following
        return keep(edges.select(F.col("a").alias("v"), F.col("b").alias("root")), edges)


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex has one edge to a lower one, or none and only edges from higher ones."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down > 0 and up > 0").isEmpty()
