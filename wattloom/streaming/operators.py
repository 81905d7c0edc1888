"""Streaming forms of operators whose batch forms live elsewhere; results agree with those."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wattloom.functions.wavelet import smoothing_matrix
from wattloom.operators.eda import dow_hour
from wattloom.params import DEFAULT, Params


def profiles(readings: DataFrame, value: str) -> DataFrame:
    """Mean by day of week and hour, kept up to date; the state has at most 7 * 24 rows."""
    return dow_hour(readings, value)


def progress(loss: DataFrame, lateness: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Newest loss and number of units per tag and minute."""
    return (
        loss.withWatermark("ts", lateness)
        .groupBy("tag", F.window("ts", width).alias("w"))
        .agg(F.max_by("loss", "ts").alias("last_loss"), F.count(F.lit(1)).alias("units"))
        .select("tag", F.col("w.start").alias("minute"), "last_loss", "units")
    )


def ingest(readings: DataFrame, lateness: str = "1 day", resolution: str = "hour") -> DataFrame:
    """One reading per building and time slot; the first to arrive stays.

    State is dropped once the watermark has passed a slot, so it does not grow with the stream.
    """
    slotted = readings.withColumn("ts", F.date_trunc(resolution, "ts"))
    return slotted.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["building", "ts"])


def label_windows(readings: DataFrame, p: Params = DEFAULT, lateness: str = "1 day") -> DataFrame:
    """A labelled window as soon as a building has enough rows that nothing can precede any more, then one every stride.

    A row waits in its building's state until the stream has seen a time more than ``lateness`` after it; a
    timer then releases it in time order, so rows that come one or several micro-batches late are sorted in,
    and the windows do not depend on how the stream was cut into micro-batches. Of rows of one time the one with
    the least energy stays (a null only if there is no other), null energies count as 0. A row that comes later
    than that is dropped and counted in ``late_rows``; one later than twice the lateness is dropped by Spark
    itself, which counts it in its own metric.

    State per building: the rows of the last ``lateness``, fewer than ``window`` values, the position of the
    first of them and the number of late rows. A row without a building
    only moves the stream's time on: a source that falls silent can send one as a heartbeat.
    """
    smoother = smoothing_matrix(p.window, p.wavelet_level).T.copy()
    width, stride, q = p.window, p.stride, (p.q_low, p.q_high)
    allowed = int(pd.Timedelta(lateness).total_seconds() * 1_000)

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        values, start, late, wait_ts, wait = state.get if state.exists else ([], 0, 0, [], [])
        bound = (state.getCurrentWatermarkMs() + allowed) * 1_000  # Spark's own watermark is twice as patient
        times, energies = [np.asarray(wait_ts, dtype=np.int64)], [np.asarray(wait, dtype=float)]
        for part in parts:
            times.append(part["micros"].to_numpy(dtype=np.int64))
            energies.append(part["energy"].to_numpy(dtype=float))
        micros, energy = np.concatenate(times), np.concatenate(energies)
        fresh = micros >= bound
        fresh[: len(wait_ts)] = True
        late += int((~fresh).sum())
        micros, energy = micros[fresh], energy[fresh]
        order = np.lexsort((energy, micros))  # NaN goes last
        micros, energy = micros[order], energy[order]
        first = np.append(True, micros[1:] != micros[:-1])[: len(micros)]
        micros, energy = micros[first], energy[first]
        ready = int(np.searchsorted(micros, bound, "left"))
        series = np.concatenate([np.asarray(values, dtype=float), np.nan_to_num(energy[:ready])])
        count = max(0, (len(series) - width) // stride + 1) if len(series) >= width else 0
        if count:
            x = np.lib.stride_tricks.sliding_window_view(series, width)[::stride][:count]
            resid = np.round(x - x @ smoother, 9)
            lo, hi = np.quantile(resid, q, axis=1)
            marks = ((resid < lo[:, None]) | (resid > hi[:, None])).astype(np.int8)
            starts = start + stride * np.arange(count)
            yield pd.DataFrame(
                {"building": key[0], "start": starts, "x": list(x), "labels": list(marks), "late_rows": late}
            )
            series, start = series[count * stride:], start + count * stride
        micros, energy = micros[ready:], energy[ready:]
        state.update((series.tolist(), start, late, micros.tolist(), energy.tolist()))
        if len(micros):  # wake up when the oldest waiting row can be released
            state.setTimeoutTimestamp(max(int(micros[0]) // 1_000 + 1 - allowed, state.getCurrentWatermarkMs() + 1))

    timed = readings.select("building", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "energy")
    return timed.withWatermark("ts", f"{2 * allowed} milliseconds").groupBy("building").applyInPandasWithState(
        step,
        "building string, start long, x array<double>, labels array<tinyint>, late_rows long",
        "values array<double>, start long, late long, wait_ts array<long>, wait array<double>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
