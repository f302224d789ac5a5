"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, spread_join, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest id that each vertex reaches: id, component, for the vertices that are not the smallest themselves.

    Large star: each vertex sends its larger neighbours to its smallest one; small star: its smaller ones. Both are an
    aggregation by vertex (tasks pre-aggregate) and a join back, in which the few vertices with very many neighbours are
    broadcast (spread_join), so a star's centre is no task of its own. The rounds end exactly when every vertex with a smaller neighbour
    has no other neighbour: then all components are stars about their smallest vertex. Their number grows with the logarithm of
    the vertices; each round's tables are written to the shared folder, those of the round before are deleted, and nothing
    reaches the driver. Loops, repeated edges and edges with null ends are left out.
    """
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(clean.distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"), F.count(F.lit(1)).alias("n")), "lows")
        if low.filter("low < u AND n > 1").isEmpty():
            discard(now)
            return low.filter("low < u").select(F.col("u").alias("id"), F.col("low").alias("component"))
        large = spread_join(both.filter("v > u"), low, ["u"], "n").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u > v").distinct()
        large = written(large, "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n")), "lows")
        moved = spread_join(large, least, ["u"], "n").filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = written(moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct(), "edges")
        discard(now, low, large, least)
        now = after
