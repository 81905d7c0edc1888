"""Sampling operators. Random ones order rows by a seeded hash, so a re-run picks the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.functions.scalars import seeded_order
from wattloom.operators.ordered import with_index


def random_k(df: DataFrame, keys: Sequence[str], k: int, seed: int) -> DataFrame:
    """k rows without replacement: a distributed top-k on the hash, no full sort."""
    ordered = df.withColumn("__h", seeded_order(*[F.col(c) for c in keys], seed=seed))
    return ordered.orderBy("__h", *keys).limit(k).drop("__h")


def random_k_per_group(df: DataFrame, group: Sequence[str], keys: Sequence[str], k: int, seed: int) -> DataFrame:
    """k rows of each group. Ranks above k are dropped before the shuffle, so a hot group stays small."""
    ordered = df.withColumn("__h", seeded_order(*[F.col(c) for c in keys], seed=seed))
    by = W.partitionBy(*group).orderBy("__h", *keys)
    return ordered.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= k).drop("__r", "__h")


def stratified(df: DataFrame, group: str, keys: Sequence[str], k: int, seed: int) -> DataFrame:
    """About k rows, each group in proportion to its size and at least one, then trimmed to k; all rows if k <= 0."""
    if k <= 0:
        return df
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__ng"))
    total = sizes.agg(F.sum("__ng")).scalar()
    quota = sizes.withColumn("__n", total).select(
        F.col(group).alias("__g"),
        F.col("__n"),
        F.greatest(F.lit(1).cast("long"), F.bround(F.lit(k) * F.col("__ng") / F.col("__n")).cast("long")).alias("__q"),
    )
    candidates = random_k_per_group(df, [group], keys, k, seed)
    ranked = candidates.withColumn("__h", seeded_order(*[F.col(c) for c in keys], seed=seed)).withColumn(
        "__r", F.row_number().over(W.partitionBy(group).orderBy("__h", *keys))
    )
    within = ranked.join(quota, ranked[group].eqNullSafe(F.col("__g"))).where(
        (F.col("__r") <= F.col("__q")) | (F.col("__n") <= k)
    )
    trim = seeded_order(*[F.col(c) for c in keys], seed=seed + 1)
    return within.select(df.columns).withColumn("__t", trim).orderBy("__t", *keys).limit(k).drop("__t")


def is_evenly_spaced(index: Column, total: Column, k: int) -> Column:
    """True for k positions spread over 0..total-1 (both ends included; k = 1 gives the first)."""
    if k == 1:
        return index == 0
    step = (total - 1) / F.lit(float(k - 1))
    guess = F.floor(index / step).cast("long")
    hit = F.lit(False)
    for d in (0, 1, 2):
        i = guess + d
        place = F.when(i == k - 1, total - 1).otherwise(F.floor(i * step).cast("long"))
        hit = hit | ((i <= k - 1) & (place == index))
    return (total <= k) | hit


def evenly_spaced(df: DataFrame, index: str, total: str, k: int) -> DataFrame:
    return df if k <= 0 else df.where(is_evenly_spaced(F.col(index), F.col(total), k))


def prefix(df: DataFrame, index: str, k: int) -> DataFrame:
    """First k positions of each series; contiguous, so overlaps stay."""
    return df if k <= 0 else df.where(F.col(index) < k)


def equalize(df: DataFrame, source: str, keys: Sequence[str], seed: int) -> DataFrame:
    """Same number of rows from every source: the size of the smallest.

    Rows get a hash rank inside (source, hash slice). Slices are cut so that the largest source has some
    ten thousand rows in each.
    """
    sizes = df.groupBy(source).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c"), F.max("c")).first()
    smallest, largest = sizes[0] or 0, sizes[1] or 0
    digits = next(d for d in range(1, 16) if largest <= 10_000 * 16**d)
    order = seeded_order(*[F.col(c) for c in keys], seed=seed)
    hashed = df.withColumn("__order", order)
    slice_no = F.conv(F.substring("__order", 1, digits), 16, 10).cast("long")
    ranked = with_index(hashed, [source], [F.col("__order"), *[F.col(c) for c in keys]], slice_no)
    return ranked.where(F.col("t") < smallest).drop("t", "n", "__order")


def pos_weight(windows: DataFrame, labels: str, backcast: int, by: Sequence[str] = ()) -> DataFrame:
    """Negatives per positive among the forecast-part labels."""
    tail = F.slice(F.col(labels), backcast + 1, F.size(labels) - backcast)
    ones = F.aggregate(tail, F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))
    counted = windows.select(*by, ones.alias("__p"), F.size(tail).cast("long").alias("__n"))
    out = counted.groupBy(*by).agg(F.sum("__p").alias("positives"), F.sum("__n").alias("points"))
    pos = F.greatest(F.col("positives"), F.lit(1).cast("long"))
    return out.withColumn("pos_weight", (F.col("points") - pos) / pos)


def num_examples(windows: DataFrame, client: str, shard: Sequence[str], cap: int = 0) -> DataFrame:
    """Windows per client; each shard counts at most ``cap`` (0: no limit)."""
    per = windows.groupBy(client, *shard).agg(F.count(F.lit(1)).alias("c"))
    counted = F.col("c") if cap <= 0 else F.least(F.col("c"), F.lit(cap).cast("long"))
    return per.groupBy(client).agg(F.sum(counted).alias("num_examples"))
