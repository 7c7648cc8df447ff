"""Connected components by alternating large-star and small-star steps, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._store import shared_folder, stored


def connected_components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Each step links nodes to the smallest neighbour, so the number of steps grows with the logarithm
    of the longest path. Nulls and self-loops are left out. A step aggregates per node (partial sums
    before the shuffle) and joins on it; the large side of a hub is split by the skew join.
    """
    spark = edges.sparkSession
    folder = folder or shared_folder(spark, "components")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = stored(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), f"{folder}/edges")
    state, step = None, 0
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), f"{folder}/large{step}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = stored(small.where("a <> b").distinct(), f"{folder}/small{step}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state, step = tuple(seen), step + 1
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
