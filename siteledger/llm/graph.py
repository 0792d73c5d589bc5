"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.shared import cut


def _stars(edges: DataFrame) -> bool:
    """Whether every id has one link, to an id that has none: then the components are found."""
    if edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return False
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """u, v: each id that a link touches, other than the smallest of its component, with that smallest id.

    Links from an id to itself and null ids count for nothing. The smallest neighbours of a step are
    written before the join with them, so Spark can split the partitions of ids with very many links.
    """
    pair = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut(pair.distinct(), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large-star")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    return edges
