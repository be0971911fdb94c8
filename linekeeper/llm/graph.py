"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekeeper.llm.store import materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node in ``links`` (a, b: long): the least node that it reaches.

    Alternates large-star and small-star steps over stored tables until no link changes;
    the number of rounds follows the logarithm of the nodes.  A node's least neighbour is
    aggregated and stored before it is joined: both sides of the join are then plain
    shuffles, in which the partition of a node with very many links can be split.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-links")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), f"{name}-large")
        small_least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small-least")
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), f"{name}-round")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
