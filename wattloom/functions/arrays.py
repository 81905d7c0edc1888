"""Array columns: Arrow functions over fixed-length windows and JVM-side array expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.functions.wavelet import smoothing_matrix


#: Windows that go through one matrix product, so that temporary arrays do not grow with the Arrow batch.
AT_ONCE = 2048


def _as_matrix(col, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _as_lists(m: np.ndarray, dtype=None):
    rows, width = m.shape
    offsets = pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).ravel(), type=dtype))


def decomposer(window: int, level: int):
    """x -> struct(trend, season): approximation-only wavelet inside the window."""
    smoother = smoothing_matrix(window, level).T.copy()

    @F.arrow_udf("struct<trend:array<double>,season:array<double>>")
    def decompose(x: pa.Array) -> pa.Array:
        m = _as_matrix(x, window)
        trend, season = np.empty(m.shape), np.empty(m.shape)
        for k in range(0, len(m), AT_ONCE):
            part = slice(k, k + AT_ONCE)
            np.matmul(m[part], smoother, out=trend[part])
            np.subtract(m[part], trend[part], out=season[part])
            np.nan_to_num(season[part], copy=False)
        return pa.StructArray.from_arrays([_as_lists(trend), _as_lists(season)], names=["trend", "season"])

    return decompose


def _marked(value: np.ndarray, smooth: Callable[[slice], np.ndarray], q_low: float, q_high: float, decimals: int):
    """struct(labels, lo, hi) of windows; ``smooth`` gives the trend of a slice of them."""
    marks, (lo, hi) = np.empty(value.shape, dtype=np.int8), np.empty((2, len(value)))
    for k in range(0, len(value), AT_ONCE):
        part = slice(k, k + AT_ONCE)
        resid = np.round(value[part] - smooth(part), decimals)
        lo[part], hi[part] = np.quantile(resid, [q_low, q_high], axis=1)
        marks[part] = (resid < lo[part, None]) | (resid > hi[part, None])
    return pa.StructArray.from_arrays(
        [_as_lists(marks, pa.int8()), pa.array(lo), pa.array(hi)],
        names=["labels", "lo", "hi"],
    )


def labeler(window: int, q_low: float, q_high: float, decimals: int = 9):
    """(x, trend) -> struct(labels, lo, hi): residual outside its own two quantiles."""

    @F.arrow_udf("struct<labels:array<tinyint>,lo:double,hi:double>")
    def label(x: pa.Array, trend: pa.Array) -> pa.Array:
        smooth = _as_matrix(trend, window)
        return _marked(_as_matrix(x, window), lambda part: smooth[part], q_low, q_high, decimals)

    return label


def decomposing_labeler(window: int, level: int, q_low: float, q_high: float, decimals: int = 9):
    """x -> struct(labels, lo, hi): decomposer and labeler in one pass, so no trend travels between two."""
    smoother = smoothing_matrix(window, level).T.copy()

    @F.arrow_udf("struct<labels:array<tinyint>,lo:double,hi:double>")
    def label(x: pa.Array) -> pa.Array:
        value = _as_matrix(x, window)
        return _marked(value, lambda part: value[part] @ smoother, q_low, q_high, decimals)

    return label


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``length[i]`` whole numbers from ``first[i]`` on, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


def _in_cells(cell: pa.Array, windows: pa.Array, name: str, block: int):
    """Windows of many cells on one axis, a cell after the other: (values, index of a window's first value, row, its first step, begin, end inside the cell)."""
    flat = windows.flatten()
    lists = flat.field(name)
    length = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(windows)), np.diff(windows.offsets.to_numpy()))
    own = row * block
    step = own + flat.field("start").to_numpy() - cell.to_numpy()[row] * block
    begin, end = np.clip(step, own, own + block), np.clip(step + length, own, own + block)
    return lists.flatten(), np.cumsum(length) - length, row, step, begin, end


def cell_votes(block: int):
    """(cell, windows) -> struct(pos, votes, cover) of the steps of a cell that windows struct(start, labels) lie over.

    A cell has ``block`` steps; of a window that reaches out of it the part inside counts.
    """

    @F.arrow_udf("struct<pos:array<int>,votes:array<int>,cover:array<int>>")
    def count(cell: pa.Array, windows: pa.Array) -> pa.Array:
        values, first, row, step, begin, end = _in_cells(cell, windows, "labels", block)
        steps = len(cell) * block
        edge = np.zeros(steps + 1, dtype=np.int32)  # cover as running sum of begins and ends
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        cover = np.cumsum(edge[:-1], dtype=np.int32)
        marks = values.cast(pa.int32()).fill_null(0).to_numpy()
        marked = np.flatnonzero(marks)
        of = np.searchsorted(first, marked, side="right") - 1
        place = step[of] + marked - first[of]
        inside = (place >= begin[of]) & (place < end[of])
        votes = np.zeros(steps, dtype=np.int32)
        np.add.at(votes, place[inside], marks[marked[inside]])
        covered = np.flatnonzero(cover)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(covered // block, minlength=len(cell)))]).astype(np.int32))
        lists = [(covered % block).astype(np.int32), votes[covered], cover[covered]]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(v)) for v in lists], names=["pos", "votes", "cover"])

    return count


def cell_values(block: int, element: str):
    """(cell, windows) -> values of the covered steps of a cell, each from its window struct(start, x) that starts first."""

    @F.arrow_udf(f"array<{element}>")
    def pick(cell: pa.Array, windows: pa.Array) -> pa.Array:
        values, first, row, step, begin, end = _in_cells(cell, windows, "x", block)
        order = np.lexsort((step, row))
        reached = np.maximum.accumulate(end[order])  # up to here earlier windows lie over the axis
        begins = np.maximum(begin[order], np.concatenate([[0], reached[:-1]]) if len(order) else reached)
        length = np.maximum(end[order] - begins, 0)
        per_cell = np.bincount(row[order], length, len(cell)).astype(np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(per_cell)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values.take(pa.array(_ranges(first[order] + begins - step[order], length))))

    return pick


def remainder_score(trend: np.ndarray, season: np.ndarray, backcast: int, eps: float = 1e-8) -> np.ndarray:
    """Stand-in probability of each future step of each window: the size of its standardised remainder."""
    z = np.abs((season[:, backcast:] - season.mean(axis=1)[:, None]) / (season.std(axis=1)[:, None] + eps))
    return z / (1 + z)


def block_kernel(
    window: int, stride: int, level: int, q_low: float, q_high: float, decimals: int = 9,
    score: Callable[[np.ndarray, np.ndarray, int], np.ndarray] | None = None, backcast: int = 0, at_once: int = AT_ONCE,
):
    """Series pieces -> struct(votes, cover, prob, probs) per position, over all windows inside each piece.

    ``votes`` and ``cover`` count the labels and windows that lie over a position; with a ``score`` of (trend, season,
    backcast) ``prob`` sums the probabilities of the windows whose future part lies over it and ``probs`` counts
    them. Pieces start at a window start. ``at_once`` windows go through one matrix product, so memory does not
    grow with the Arrow batch, and no window is ever a row.
    """
    smoother = smoothing_matrix(window, level).T.copy()

    @F.arrow_udf("struct<votes:array<int>,cover:array<int>,prob:array<double>,probs:array<int>>")
    def fuse(x: pa.Array) -> pa.Array:
        flat = x.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(x.offsets.to_numpy())
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, dtype=np.int64)
        counts = np.where(lengths >= window, (lengths - window) // stride + 1, 0)
        starts = np.repeat(first, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * stride
        votes, probs = np.zeros((2, len(flat)), dtype=np.int32)
        prob = np.zeros(len(flat) if score else 0)
        edge = np.zeros(len(flat) + 1, dtype=np.int32)  # cover as running sum of window starts and ends
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        cover = np.cumsum(edge[:-1], dtype=np.int32)
        for k in range(0, len(starts), at_once):
            place = starts[k : k + at_once, None] + np.arange(window)[None, :]
            m = flat[place]
            trend = m @ smoother
            resid = np.round(m - trend, decimals)
            lo, hi = np.quantile(resid, [q_low, q_high], axis=1)
            np.add.at(votes, place[(resid < lo[:, None]) | (resid > hi[:, None])], 1)
            if score:
                future = place[:, backcast:]
                low = int(future[0, 0])
                got = score(trend, np.nan_to_num(m - trend), backcast)
                inner = future.ravel() - low
                n = int(future[-1, -1]) - low + 1
                prob[low : low + n] += np.bincount(inner, got.ravel(), n)
                probs[low : low + n] += np.bincount(inner, minlength=n).astype(np.int32)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (votes, cover)]
        if score:
            lists += [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (prob, probs)]
        else:
            lists += [pa.nulls(len(x), pa.list_(pa.float64())), pa.nulls(len(x), pa.list_(pa.int32()))]
        return pa.StructArray.from_arrays(lists, names=["votes", "cover", "prob", "probs"])

    return fuse


def standardizer(window: int, eps: float = 1e-8):
    """a -> struct(z, mean, std): z-score with the population deviation."""

    @F.arrow_udf("struct<z:array<double>,mean:double,std:double>")
    def standardize(a: pa.Array) -> pa.Array:
        m = _as_matrix(a, window)
        z, (mean, std) = np.empty(m.shape), np.empty((2, len(m)))
        for k in range(0, len(m), AT_ONCE):
            part = slice(k, k + AT_ONCE)
            mean[part], std[part] = m[part].mean(axis=1), m[part].std(axis=1)
            np.subtract(m[part], mean[part, None], out=z[part])
            z[part] /= std[part, None] + eps
        return pa.StructArray.from_arrays([_as_lists(z), pa.array(mean), pa.array(std)], names=["z", "mean", "std"])

    return standardize


def unscale_array(a: Column, mean: Column, std: Column, eps: float = 1e-8) -> Column:
    return F.transform(a, lambda v: v * (std + F.lit(eps)) + mean)


def past(a: Column, backcast: int) -> Column:
    return F.slice(a, 1, backcast)


def future(a: Column, backcast: int, forecast: int) -> Column:
    return F.slice(a, backcast + 1, forecast)
