"""Anomaly labels inside windows and their fusion per time step."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.arrays import block_kernel, cell_values, cell_votes, decomposing_labeler, labeler
from wattloom.operators.clean import KEYS
from wattloom.operators.ordered import gather_blocks
from wattloom.operators.windows import decompose, make_windows
from wattloom.params import DEFAULT, Params


def _with_labels(windows: DataFrame, found: Column) -> DataFrame:
    return windows.withColumn("__l", found).select(
        *windows.columns,
        F.col("__l.labels").alias("labels"),
        F.col("__l.lo").alias("q_lo"),
        F.col("__l.hi").alias("q_hi"),
    )


def label_windows(windows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Add ``labels`` and the residual quantiles ``q_lo`` / ``q_hi`` of the window itself."""
    return _with_labels(windows, labeler(p.window, p.q_low, p.q_high)("x", "trend"))


def label_series(series: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Windows -> trend -> labels. Training and scoring both call this, so labels agree.

    The same rows as ``label_windows(decompose(make_windows(series)))``; labels are found in the pass that
    decomposes a window, so its trend does not travel to Python a second time.
    """
    run = decomposing_labeler(p.window, p.wavelet_level, p.q_low, p.q_high)
    return _with_labels(decompose(make_windows(series, p, keys), p), run("x"))


def band(labeled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per point: trend, band limits, whether the point lies outside."""
    return labeled.select(
        *keys, "start", "q_lo", "q_hi", F.posexplode(F.arrays_zip("x", "trend", "labels")).alias("pos", "v")
    ).select(
        *keys,
        "start",
        (F.col("start") + F.col("pos")).alias("t"),
        F.col("v.x").alias("x"),
        F.col("v.trend").alias("trend"),
        (F.col("v.trend") + F.col("q_lo")).alias("band_lo"),
        (F.col("v.trend") + F.col("q_hi")).alias("band_hi"),
        F.col("v.labels").cast("int").alias("outside"),
    )


def rule(votes: Column, cover: Column, merge_rule: str) -> Column:
    if merge_rule == "any":
        return (votes > 0).cast("int")
    if merge_rule == "majority":
        return F.coalesce((votes / F.nullif(cover, F.lit(0)) > 0.5).cast("int"), F.lit(0))
    raise ValueError(f"unknown merge rule {merge_rule!r}")


def fuse(labeled: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per covered time step: energy, votes, cover and the fused ``anomaly``.

    Windows go whole to each cell of ``p.block`` steps that they lie over, and all steps of a cell are counted at once
    from their arrays; a step becomes a row only when it is done. The energy is that of the window that starts first.
    """
    def cell(t: Column) -> Column:
        return F.floor(t / p.block).cast("long")

    touched = F.sequence(cell(F.col("start")), cell(F.col("start") + F.size("labels") - 1))
    at = [*keys, "__cell"]
    gathered = labeled.select(*keys, "start", "x", "labels", F.explode(touched).alias("__cell")).groupBy(F.hash(*at).alias("__h"), *at).agg(
        F.collect_list(F.struct("start", "labels")).alias("__labels"), F.collect_list(F.struct("start", "x")).alias("__x"),
    )
    element = labeled.schema["x"].dataType.elementType.simpleString()
    counted = gathered.select(
        *at, cell_votes(p.block)("__cell", "__labels").alias("__v"), cell_values(p.block, element)("__cell", "__x").alias("__e"),
    )
    whole = counted.select("*", F.posexplode("__v.pos").alias("__i", "__pos")).select(
        *keys, (F.col("__cell") * p.block + F.col("__pos")).alias("t"),
        F.get("__e", "__i").alias("energy"),
        F.get("__v.votes", "__i").cast("long").alias("votes"),
        F.get("__v.cover", "__i").cast("long").alias("cover"),
    )
    return whole.withColumn("anomaly", rule(F.col("votes"), F.col("cover"), p.merge_rule))


def _kernel_points(series: DataFrame, p: Params, keys: Sequence[str], reach: int, **options) -> DataFrame:
    """(keys, __blk, __t, __energy, __v) of every block: steps and energies it sees, ``reach`` rows after its own ones included, and
    what ``block_kernel`` counts over them."""
    back = p.window - p.stride
    before = -(-back // p.stride) * p.stride
    pieces = gather_blocks(series.select(*keys, "t", "energy"), keys, "t", p.block, ["t", "energy"], before=before, after=reach)
    run = block_kernel(p.window, p.stride, p.wavelet_level, p.q_low, p.q_high, backcast=p.backcast, **options)
    return pieces.withColumn("__v", run("__energy"))


def label_fused(
    series: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS, score: Callable[..., Any] | None = None
) -> DataFrame:
    """Series straight to fused labels: the same rows as ``fuse(label_series(series))``.

    A block also sees the rows before it that windows covering its own rows start at, so all votes
    for a row are counted where the row lies: one shuffle in all, and no window leaves its task. With a
    ``score`` (see ``block_kernel``) the same pass gives ``y_prob``, the mean probability of the overlapping
    forecasts of a row; null where no forecast reaches.
    """
    counted = _kernel_points(series, p, keys, p.window - p.stride, score=score)
    points = counted.select("*", F.posexplode("__t").alias("__i", "t")).select(
        *keys, "__blk", "t", F.get("__energy", "__i").alias("energy"),
        F.get("__v.votes", "__i").cast("long").alias("votes"), F.get("__v.cover", "__i").cast("long").alias("cover"),
        *([(F.get("__v.prob", "__i") / F.nullif(F.get("__v.probs", "__i"), F.lit(0))).alias("y_prob")] if score else []),
    )
    own = F.floor(F.col("t") / p.block) == F.col("__blk")
    return points.where(own & (F.col("cover") > 0)).drop("__blk").withColumn(
        "anomaly", rule(F.col("votes"), F.col("cover"), p.merge_rule)
    )


def label_reprojected(series: DataFrame, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Windows (keys, blk, start, x, labels_fused) with the fused label of each of their steps.

    The same rows as ``reproject(label_fused(series))``, but labelled once and shuffled once: a block that
    sees two windows' reach after its own rows has all votes for every step of the windows that start in it.
    """
    reach = p.window - p.stride
    if 2 * reach > p.block:
        return reproject(label_fused(series, p, keys), p=p, keys=keys)
    counted = _kernel_points(series, p, keys, 2 * reach)
    marks = F.transform(F.arrays_zip(F.col("__v.votes").alias("votes"), F.col("__v.cover").alias("cover")), lambda m: rule(m["votes"], m["cover"], p.merge_rule))
    placed = counted.select(
        *keys, "__blk", F.col("__energy").alias("__x"), marks.alias("__m"), F.col("__t")[0].alias("__t0"), F.size("__t").alias("__size"),
    )
    own = F.col("__blk") * p.block
    # windows start on the stride from the first row on, which is a window start, inside the block's own rows
    last = F.least(own + p.block - p.stride, F.col("__t0") + F.col("__size") - p.window)
    count = F.when(last >= own, F.floor((last - own) / p.stride) + 1).otherwise(0)
    cuts = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: F.struct(
        (own + k * p.stride).alias("start"),
        F.slice("__x", (own + k * p.stride - F.col("__t0") + 1).cast("int"), F.lit(p.window)).alias("x"),
        F.slice("__m", (own + k * p.stride - F.col("__t0") + 1).cast("int"), F.lit(p.window)).alias("labels_fused"),
    )))
    return placed.select(*keys, F.col("__blk").alias("blk"), F.explode(cuts).alias("w")).select(*keys, "blk", "w.*")


def reproject(fused: DataFrame, lengths: DataFrame | None = None, p: Params = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fused labels cut back into windows as ``labels_fused``; windows line up with the originals.

    ``lengths`` (keys, n) is only carried along; without it the windows have no ``n``.
    """
    series = fused.join(lengths.select(*keys, "n"), list(keys)) if lengths is not None else fused.withColumn("n", F.lit(None).cast("long"))
    out = make_windows(series, p, keys, {"x": "energy", "labels_fused": "anomaly"})
    return out if lengths is not None else out.drop("n")


def join_back(series: DataFrame, fused: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Labels on the original rows; rows no window covers get 0."""
    return series.join(fused.select(*keys, "t", "anomaly"), [*keys, "t"], "left").withColumn(
        "anomaly", F.coalesce("anomaly", F.lit(0))
    )


def rates(fused: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per building and group: share of anomalous steps, and the same weighted by windows."""
    per = fused.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum("anomaly").alias("anomalies"),
        F.sum("cover").alias("window_steps"),
        F.sum(F.col("anomaly") * F.col("cover")).alias("window_anomalies"),
    )
    return per.withColumns(
        {
            "series_rate": F.col("anomalies") / F.col("steps"),
            "window_rate": F.col("window_anomalies") / F.col("window_steps"),
        }
    )


def group_rates(building_rates: DataFrame) -> DataFrame:
    return building_rates.groupBy("grp").agg(
        F.count(F.lit(1)).alias("buildings"),
        (F.sum("anomalies") / F.sum("steps")).alias("series_rate"),
        (F.sum("window_anomalies") / F.sum("window_steps")).alias("window_rate"),
        F.avg("series_rate").alias("mean_building_rate"),
    )
