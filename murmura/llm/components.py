"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.common import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v): hang each neighbour of u (a large star: the larger ones, else the smaller) on the least of u and its neighbours."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = near.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node reachable.

    edges has long columns u and v; loops, repeats and either direction are fine,
    rows with a null are no edges. Rounds go on until one changes nothing, which takes
    about the logarithm of the longest chain. Each round writes its edges to the shared
    folder, so lineage stays short, and drops those of the round before; only the two
    numbers that tell whether a round changed anything come to the driver.
    """
    now, mark = stored(edges.select("u", "v").dropna().filter("u <> v").distinct()), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark, before = (seen.n, seen.h), now
        now = stored(_star(_star(now, True), False))
        forget(before)
