"""Connected components of links by alternating large-star and small-star steps.

Each step is one round of joins and aggregations; its result is stored, so lineage stays short and a lost executor costs
no more than the step. The number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.session import materialise


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one root and no root is a node, so that another round would change nothing."""
    ends = edges.select(F.col("node").alias("u"), F.lit(1).alias("below")).unionAll(
        edges.select(F.col("root").alias("u"), F.lit(0).alias("below"))
    )
    each = ends.groupBy("u").agg(F.sum("below").alias("roots"), F.count(F.lit(1)).alias("n"))
    return each.agg(F.count_if((F.col("roots") > 0) & (F.col("n") > 1)).alias("open")).first()["open"] == 0


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node that has a link; ``links`` has columns a and b. The root is the smallest node."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    edges = materialise(edges, "edges")
    for _ in range(most_rounds):
        if _settled(edges):
            return edges
        ways = edges.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(
            edges.select(F.col("root").alias("u"), F.col("node").alias("v"))
        )
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root"))
        large = materialise(large, "large-star")  # a row for each edge at most; the small star drops those that are equal
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(low, "node").where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        edges = materialise(small.unionAll(low.select("node", F.col("m").alias("root"))).distinct(), "small-star")
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")
