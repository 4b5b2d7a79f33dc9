"""Connected components of a link table by alternating star steps: each step
is a grouped minimum and a join, so components never meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b), where root is the
    smallest node of the component.  The smallest nodes themselves are left out."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "edges")
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = stored(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one root and no root points on."""
    n, nodes = edges.agg(F.count("*"), F.countDistinct("u")).first()
    return n == nodes and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
