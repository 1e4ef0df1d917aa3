"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm._tables import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or else smaller) neighbours to the smallest node around."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        new = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        new = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for all ends of edges (u, v: long). Each round is written down.

    A hub's edges lie in one join key, with a single row on the other side, so that Spark's skew join can split them.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = None
    while True:
        new = cut(_star(_star(now, True), False), "edges")
        found = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = new
        if found == sign:
            break
        sign = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
