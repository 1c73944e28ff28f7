"""Connected components by alternating large-star and small-star rounds, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markfield.llm.shared import cut, dealt, settled


@settled()
def components(edges: DataFrame) -> DataFrame:
    """node long, component long (the smallest node of its component) for every node that has an edge.

    edges: u long, v long in either direction, repeats and loops allowed.  Each round is two aggregations and two
    joins by node, written to the shared folder; the number of rounds grows with the logarithm of the diameter.
    A node with very many neighbours is only ever aggregated by min or split by the join, never collected."""
    pairs = cut(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )  # u > v throughout
    n = pairs.count()
    while True:
        files = max(8, n // 250_000)  # rounds make hardly more pairs
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(dealt(least, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, files)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(low, n), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = cut(small.select("e.u", "e.v").where("u != v").distinct(), files)
        before, n = n, new.count()
        # Both are sets, so they are equal if they have as many pairs and none of the new ones is new.
        same = n == before and not new.join(dealt(pairs, n), ["u", "v"], "left_anti").limit(1).collect()
        pairs = new
        if same:
            break
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
