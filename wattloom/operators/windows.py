"""Overlapping windows, decomposition and scaling.

Input is an indexed series (``t`` dense from 0, ``n`` rows). One shuffle on (building, block)
gathers a block and the rows after it that its last windows reach; windows are slices of that
bounded array. A row is copied (window - stride) / block times on average, not window / stride.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.functions.arrays import decomposer, future, past, standardizer
from wattloom.functions.scalars import window_count
from wattloom.functions.wavelet import smooth
from wattloom.operators.clean import KEYS
from wattloom.operators.ordered import gather_blocks, with_halo
from wattloom.params import DEFAULT, Params


def make_windows(
    df: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS, columns: dict[str, str] | None = None
) -> DataFrame:
    """Windows of ``p.window`` rows every ``p.stride`` rows.

    ``columns`` maps output array names to input columns; default ``x`` from ``energy``.
    Output: keys, n, blk, start and one array per column.
    """
    columns = columns or {"x": "energy"}
    width, stride, block = p.window, p.stride, p.block
    gathered = gather_blocks(
        df.select(*keys, "t", "n", *[F.col(c).alias(a) for a, c in columns.items()]),
        keys, "t", block, list(columns), after=width - stride, per_key=["n"],
    )
    count = window_count(F.size(f"__{next(iter(columns))}"), width, stride)
    cuts = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))
    return gathered.withColumn("__k", F.explode(cuts)).select(
        *keys, "n", F.col("__blk").alias("blk"),
        (F.col("__blk") * block + F.col("__k") * stride).alias("start"),
        *[F.slice(f"__{a}", (F.col("__k") * stride + 1).cast("int"), F.lit(width)).alias(a) for a in columns],
    )


def with_window_count(series: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return series.withColumn("n_windows", window_count(F.col("n"), p.window, p.stride))


def decompose(windows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Add ``trend`` and ``season``; each depends on its own window only."""
    run = decomposer(p.window, p.wavelet_level)
    return windows.withColumn("__d", run("x")).select(
        *windows.columns, F.col("__d.trend").alias("trend"), F.col("__d.season").alias("season")
    )


def standardize(windows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Add ``trend_norm``, ``season_norm`` and ``stats`` (mean and deviation of both parts)."""
    run = standardizer(p.window)
    scaled = windows.withColumns({"__t": run("trend"), "__s": run("season")})
    return scaled.select(
        *windows.columns,
        F.col("__t.z").alias("trend_norm"),
        F.col("__s.z").alias("season_norm"),
        F.struct(
            F.col("__t.mean").alias("tm"), F.col("__t.std").alias("ts"),
            F.col("__s.mean").alias("sm"), F.col("__s.std").alias("ss"),
        ).alias("stats"),
    )


def backcast_forecast(windows: DataFrame, columns: Sequence[str], p: Params = DEFAULT) -> DataFrame:
    """Input part ``<c>_in`` and target part ``<c>_out`` of each array column."""
    cols: dict[str, Column] = {}
    for c in columns:
        cols[f"{c}_in"] = past(F.col(c), p.backcast)
        cols[f"{c}_out"] = future(F.col(c), p.backcast, p.forecast)
    return windows.withColumns(cols)


def pick(series: DataFrame, grp: str, building: str, skip: int, count: int, p: Params = DEFAULT) -> DataFrame:
    """``count`` windows of one building in time order after the first ``skip``; only rows of their blocks are cut into windows."""
    first, last = skip * p.stride, (skip + count - 1) * p.stride
    rows = series.where((F.col("grp") == grp) & (F.col("building") == building) & F.col("t").between(first - first % p.block, last + p.window - 1))
    return make_windows(rows, p).where(F.col("start").between(first, last))


def inventory(windows: DataFrame) -> DataFrame:
    """Buildings and windows per group. Buildings are counted after a per-building reduction."""
    per = windows.groupBy("grp", "building").agg(F.count(F.lit(1)).alias("w"))
    return per.groupBy("grp").agg(F.count(F.lit(1)).alias("buildings"), F.sum("w").alias("windows"))


def frames(series: DataFrame, first: int, count: int, p: Params = DEFAULT) -> DataFrame:
    """Bounds of ``count`` consecutive window positions from ``first``, per building."""
    per = series.groupBy("grp", "building").agg(F.max("n").alias("n"))
    start = F.lit(first) + F.col("frame") * p.stride
    return (
        per.select("grp", "building", "n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("frame"))
        .select(
            "grp", "building", "frame",
            start.alias("start"),
            (start + p.backcast).alias("backcast_end"),
            (start + p.backcast + p.val_horizon).alias("val_end"),
            (start + p.window).alias("window_end"),
            "n",
        )
        .where(F.col("window_end") <= F.col("n"))
        .drop("n")
    )


def standardize_series(df: DataFrame, column: str = "energy", keys: Sequence[str] = KEYS, eps: float = 1e-8) -> DataFrame:
    """z-score over the whole series. The moments are reduced first, then joined back."""
    per = df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return df.join(per, list(keys)).withColumn(
        f"{column}_norm", (F.col(column) - F.col("mean")) / (F.col("std") + F.lit(eps))
    )


def series_wavelet(
    df: DataFrame, keys: Sequence[str] = KEYS, level: int = 5, block: int = 4096
) -> DataFrame:
    """Trend of the whole series at a fixed level; looks ahead, kept for comparison only.

    The filter reaches less than 14 * 2**level rows to either side, so a block with that halo
    gives the same numbers as the whole series, and no task needs one.
    """
    step = 2**level
    halo = -(-14 * step // step) * step
    block = max(block, halo)
    block = -(-block // step) * step
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    names = [*keys, "t", "energy", "trend"]

    def run(part):
        part = part.sort_values("t", ignore_index=True)
        part["trend"] = smooth(np.ascontiguousarray(part["energy"].to_numpy(dtype=float)), level)
        return part.loc[part["__own"], names]

    out = (
        with_halo(df.select(*keys, "t", "energy"), "t", block, before=halo, after=halo)
        .groupBy(*keys, "__blk")
        .applyInPandas(run, f"{fields}, t long, energy double, trend double")
    )
    return out.withColumn("season", F.col("energy") - F.col("trend"))


def series_additive(df: DataFrame, keys: Sequence[str] = KEYS, period: int = 24, block: int = 8192) -> DataFrame:
    """Trend by a centred moving average of one period; both ends continue the nearest line.

    Ends: a least-squares line over the ``period`` trend points next to the gap.
    """
    half = period // 2
    halo = with_halo(df.select(*keys, "t", "n", "energy"), "t", block, before=half, after=half)
    near = W.partitionBy(*keys, "__blk").orderBy("t")
    if period % 2 == 0:
        total = F.sum("energy").over(near.rowsBetween(-half, half))
        ends = F.lag("energy", half).over(near) + F.lead("energy", half).over(near)
        mean = (total - 0.5 * ends) / period
    else:
        mean = F.avg("energy").over(near.rowsBetween(-half, half))
    inner = F.col("t").between(half, F.col("n") - 1 - half)
    averaged = (
        halo.withColumn("trend", mean).where("__own").drop("__own", "__blk")
        .withColumn("trend", F.when(inner, F.col("trend")))
        .where(F.col("n") >= 2 * period)
    )
    t = F.col("t").cast("double")
    head = F.when(F.col("t").between(half, half + period - 1), F.col("trend"))
    tail = F.when(F.col("t").between(F.col("n") - half - period, F.col("n") - 1 - half), F.col("trend"))
    lines = averaged.groupBy(*keys).agg(
        F.regr_slope(head, t).alias("__hs"), F.regr_intercept(head, t).alias("__hi"),
        F.regr_slope(tail, t).alias("__ts"), F.regr_intercept(tail, t).alias("__ti"),
    )
    edge = averaged.where(~inner).join(lines, list(keys))
    front = F.col("t") < half
    filled = edge.withColumn(
        "trend",
        F.when(front, F.col("__hs") * t + F.col("__hi")).otherwise(F.col("__ts") * t + F.col("__ti")),
    ).select(averaged.columns)
    return averaged.where(inner).unionByName(filled).withColumn("season", F.col("energy") - F.col("trend"))
