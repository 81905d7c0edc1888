"""Train/test cuts. All of them need only the row's position ``t`` and the series length ``n``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalars import md5_mod
from wattloom.params import DEFAULT, Params


def _cut(p: Params) -> Column:
    return F.floor(F.col("n") * F.lit(float(p.train_frac))).cast("long")


def temporal(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """First part train, rest test; ``t`` and ``n`` restart in each part; short parts go."""
    cut = _cut(p)
    first = F.col("t") < cut
    return (
        df.withColumn("split", F.when(first, "train").otherwise("test"))
        .withColumns(
            {
                "t": F.when(first, F.col("t")).otherwise(F.col("t") - cut),
                "n": F.when(first, cut).otherwise(F.col("n") - cut),
            }
        )
        .where(F.col("n") >= p.window)
    )


def by_building(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Whole buildings to one side, by a hash of "group:building"."""
    bucket = md5_mod(F.concat_ws(":", "grp", "building"), 100)
    return df.withColumn(
        "split", F.when(bucket < F.lit(p.train_frac * 100), "train").otherwise("test")
    ).where(F.col("n") >= p.window)


def fixed(df: DataFrame, train_len: int = 4320, val_len: int = 2160) -> DataFrame:
    """Fixed lengths; test is everything after train, so a row may be in val and in test."""
    t, n = F.col("t"), F.col("n")
    short = n < train_len + val_len + 1
    border = F.when(short, F.floor(n / 2).cast("long")).otherwise(F.lit(train_len).cast("long"))
    val_end = F.when(short, n).otherwise(F.lit(train_len + val_len).cast("long"))
    part = (
        F.when(t < border, F.array(F.lit("train")))
        .when(t < val_end, F.array(F.lit("val"), F.lit("test")))
        .otherwise(F.array(F.lit("test")))
    )
    return df.withColumn("split", F.explode(part)).withColumn(
        "t", F.when(F.col("split") == "train", t).otherwise(t - border)
    )


def boundary(splits: DataFrame) -> DataFrame:
    """Per building: length of train and test as stored, and the true train fraction."""
    per = splits.groupBy("grp", "building").agg(
        F.count_if(F.col("split") == "train").alias("boundary"), F.count(F.lit(1)).alias("total")
    )
    return per.withColumn("train_fraction", F.col("boundary") / F.col("total"))


def joined_series(splits: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Train followed by test on one position axis."""
    return splits.join(boundaries, ["grp", "building"]).withColumn(
        "t", F.when(F.col("split") == "train", F.col("t")).otherwise(F.col("t") + F.col("boundary"))
    )


def summary(cleaned: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per group: buildings kept or too short, rows read and rows written."""
    per = cleaned.groupBy("grp", "building").agg(F.count(F.lit(1)).alias("n"))
    cut = _cut(p)
    train, test = cut, F.col("n") - cut
    written = F.when(train >= p.window, train).otherwise(0) + F.when(test >= p.window, test).otherwise(0)
    kept = F.col("n") >= p.min_len
    return per.groupBy("grp").agg(
        F.count(F.lit(1)).alias("buildings"),
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("too_short"),
        F.sum("n").alias("rows_read"),
        F.sum(F.when(kept, written).otherwise(0)).alias("rows_written"),
    )
