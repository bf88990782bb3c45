"""Connected components of a link table by alternating star contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_stash, stash


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: (a, b) of one orderable type. Returns (node, root) for every node in a link, root the least node reachable.

    Each round hangs a node's larger neighbours, then its smaller ones, on the least node it knows; rounds grow with the
    logarithm of the longest chain. Tables go through the shared folder each round; a count and a checksum, not links,
    reach the driver. Both stars take the least neighbour by a map-side combined aggregate, so the centre of a large
    star costs a row per task.
    """
    spark = links.sparkSession
    now, path = stash(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # here every row has a > b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new, new_path = stash(small.distinct(), "links")
        drop_stash(spark, path)
        now, path = new, new_path
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
