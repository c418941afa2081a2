"""Connected components by alternating large-star and small-star rounds; nothing but a checksum reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

#: A hub's neighbours are dealt out by this many salts, so that no task holds them all.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """An equi-join where ``on`` may be hot on the left and is unique on the right: left rows are spread by their hash."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "_salt"], how).drop("_salt")


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """From edges (u, v) of longs: (node, root), where root is the smallest node reachable; only nodes that have an edge.

    Loops and repeated edges don't matter; an empty table gives an empty one.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        # large-star: neighbours above a node go to the smallest of its neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = salted_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: neighbours below a node, and the node, go to the smallest of them
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = salted_join(large, least, "u")
        before, e = e, materialize(below.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        drop(before, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if tuple(now) == last and now[0] == now[2] or not now[0]:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
