"""Cleaning: one row per timestamp, trimmed ends, minimum length, dense position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalars import null_if_nan
from wattloom.operators.ordered import time_bucket, with_index
from wattloom.params import DEFAULT, Params

KEYS = ("grp", "building")
#: Rows of an untimed source that are ordered in one group.
ROWS_PER_SLICE = 65_536


def dedup(df: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """First reading per timestamp in source order. Copies collapse before the shuffle.

    Rows of sources without a time column (``timed`` false) have no timestamp to agree on: all of them stay,
    and ``place`` keeps their file and row, by which they are ordered. A null time in a source that has a
    time column is a timestamp like any other.
    """
    first = F.min_by("energy", F.struct(*order)).alias("energy")
    if "timed" not in df.columns:
        return df.groupBy(*keys, "ts").agg(first)
    place = F.when(~F.col("timed"), F.struct("file", "row")).alias("place")
    return df.withColumn("place", place).groupBy(*keys, "ts", "place").agg(first)


def mean_duplicates(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean reading per timestamp (the exploratory rule)."""
    return df.groupBy(*keys, "ts").agg(F.avg("energy").alias("energy"))


def index_series(df: DataFrame, keys: Sequence[str] = KEYS, p: Params = DEFAULT, trim: bool = True) -> DataFrame:
    """Add ``t`` and ``n``; with ``trim`` leading and trailing nulls go, inner ones stay.

    Rows with a ``place`` (see ``dedup``) follow the timed ones in the order of file and row.
    """
    valid = F.col("energy").isNotNull() if trim else None
    bucket = time_bucket("ts", p.order_span_seconds)
    if "place" not in df.columns:
        return with_index(df, keys, [F.col("ts")], bucket, valid=valid)
    fields = dict(df.select("place.row").dtypes)["row"]
    line = F.expr("place.row.line") if fields.startswith("struct") else F.col("place.row").cast("long")
    block = F.expr("place.row.block") if fields.startswith("struct") else F.lit(0)
    slices = F.struct(bucket.alias("t"), F.col("place.file").alias("f"), block.cast("long").alias("b"), F.floor(line / ROWS_PER_SLICE).alias("l"))
    return with_index(df, keys, [F.col("ts"), F.col("place")], slices, valid=valid).drop("place")


def min_length(df: DataFrame, rows: int) -> DataFrame:
    return df.where(F.col("n") >= rows)


def zero_fill(df: DataFrame, column: str = "energy") -> DataFrame:
    return df.withColumn(column, F.coalesce(null_if_nan(F.col(column)), F.lit(0.0)))


def clean(df: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS, p: Params = DEFAULT) -> DataFrame:
    """All parts of a building together: dedup, trim, index, drop short series."""
    numbers = df.withColumn("energy", null_if_nan(F.col("energy")))
    return min_length(index_series(dedup(numbers, order, keys), keys, p), p.min_len)


def in_groups(df: DataFrame, devices: DataFrame, device: int) -> DataFrame:
    """Rows of the groups a device holds; an exact match on the group name."""
    return df.join(devices.where(F.col("device") == device).select("grp"), "grp", "left_semi")


def group_contains(df: DataFrame, part: str | Sequence[str], column: str = "grp") -> DataFrame:
    """Rows whose group name contains one of the given texts, ignoring case."""
    parts = [part] if isinstance(part, str) else list(part)
    cond: Column = F.lit(False)
    for x in parts:
        cond = cond | F.lower(F.col(column)).contains(x.lower())
    return df.where(cond)
