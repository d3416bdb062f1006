"""Connected components by alternating large-star and small-star steps.

Each step takes the smallest neighbour of a node by a grouped minimum and hands it on by a join, so the neighbours of a hub are never
gathered. Rounds are stored in the shared folder; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import remove, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node point to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of these. Edges run from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of one orderable type -> (node, root) for every node that has an edge to another; root is the smallest node.

    Null ends and loops are left out; repeated edges and both directions are allowed.
    """
    spark = edges.sparkSession
    given = edges.where("u is not null and v is not null and u != v")
    now, path = stored(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if found["n"] == 0 or tuple(found) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(found)
        before = path
        now, path = stored(_small_star(_large_star(now).distinct()), "edges")
        remove(spark, before)
