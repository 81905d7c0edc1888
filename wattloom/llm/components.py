"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each neighbour v of u with the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, label) of every vertex with an edge; the label is the smallest vertex of its component.

    Every round is two joins on a shared key and is written out, so a lost executor repeats one round only.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    seen = None
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = _star(large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "star")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(2**31))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("v"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v").alias("label"))).distinct()
