"""Connected components of an edge table, by repeated star contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.llm.steps import step


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the least node of its component.

    Large-star and small-star steps alternate until the edges stay as they are: each
    step ties nodes to the least neighbour, found by an aggregate with map-side combine
    and joined back, so a node with very many neighbours needs no task of its own. The
    edges are written after each step; an empty table gives an empty result.
    """
    now = step(edges.select("a", "b").where("a <> b").distinct(), label)
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        roots = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(roots, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = step(small, label)
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if sign == tuple(found):
            break
        sign = tuple(found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
