"""Rolling-origin folds and temporal hold-outs.

A window row carries its series length ``n``; everything follows from ``start`` and ``n``, so
none of these needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalars import window_count
from wattloom.params import DEFAULT, Params


def covered_end(p: Params) -> Column:
    """First position after the last window of the series."""
    return (window_count(F.col("n"), p.window, p.stride) - 1) * p.stride + p.window


def rolling_origin(windows: DataFrame, p: Params = DEFAULT, mode: str = "expanding") -> DataFrame:
    """Rows (window, fold, role). A window may appear in several folds.

    The first cutoff is ``initial_frac`` of the covered series, rounded down to a stride; each fold
    moves it by the validation horizon.
    """
    first = F.floor(covered_end(p) * F.lit(float(p.initial_frac))).cast("long")
    first = first - first % p.stride
    cutoff = first + F.col("fold") * p.val_horizon
    end = F.col("start") + p.window
    train = end <= cutoff
    if mode == "sliding":
        train = train & (F.col("start") >= cutoff - p.train_span)
    elif mode != "expanding":
        raise ValueError(f"unknown mode {mode!r}")
    val = (F.col("start") + p.backcast >= cutoff) & (end <= cutoff + p.val_horizon)
    roles = F.array_compact(F.array(F.when(train, "train"), F.when(val, "val")))
    return (
        windows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(p.n_folds - 1))))
        .withColumn("cutoff", cutoff)
        .withColumn("role", F.explode(roles))
    )


def fold_counts(folds: DataFrame) -> DataFrame:
    """Sizes per fold; folds without both sides are dropped."""
    return (
        folds.groupBy("fold")
        .agg(
            F.count_if(F.col("role") == "train").alias("train"),
            F.count_if(F.col("role") == "val").alias("val"),
        )
        .where((F.col("train") > 0) & (F.col("val") > 0))
    )


def require_folds(counts: DataFrame) -> DataFrame:
    """The counts, or an error when no fold is usable."""
    if counts.isEmpty():
        raise ValueError("no usable fold: lower initial_frac or give longer series")
    return counts


def hold_out(windows: DataFrame, p: Params = DEFAULT, mode: str = "tail") -> DataFrame:
    """Add ``in_train`` and ``in_val``.

    tail: the last share of each building's windows is validation. head: training and validation
    are both the part before that tail, kept for comparison with older results.
    """
    total = window_count(F.col("n"), p.window, p.stride)
    n_val = F.greatest(F.lit(1).cast("long"), F.floor(total * F.lit(float(p.val_frac))).cast("long"))
    tail = F.floor(F.col("start") / p.stride).cast("long") >= total - n_val
    if mode == "tail":
        return windows.withColumns({"in_train": ~tail, "in_val": tail})
    if mode == "head":
        return windows.withColumns({"in_train": ~tail, "in_val": ~tail})
    raise ValueError(f"unknown mode {mode!r}")
