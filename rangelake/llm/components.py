"""Connected components of a graph whose edges are spread over the cluster, by alternating stars.

Each round points neighbours at the smallest node they know, once from below and once from above, by a minimum with sums
on the sending side and an equi-join that adaptive execution splits where a node has very many edges. Rounds grow with
the logarithm of the longest path; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm.packs import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select("v", "m").where("v <> m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), both long; root is the smallest node of the component.

    Edges from a node to itself make a component of one; repeated edges change nothing; no edges give no rows.
    """
    edges = stored(edges)  # read several times
    loops = edges.where("u = v").select("u").distinct()
    now = stored(edges.where("u <> v").distinct())
    while True:
        after = stored(_small_star(_large_star(now)).where("u <> v").distinct())
        # star edges (node, root) repeat themselves: equal tables end the rounds
        same = now.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        new = after.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now = after
        if tuple(same) == tuple(new):
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(roots).unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
