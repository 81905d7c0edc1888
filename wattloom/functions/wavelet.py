"""Approximation-only wavelet smoothing.

Dropping every detail band is linear in the window, so for a fixed window length the smoother is
one constant matrix. It is built once on the driver (W x W numbers, W fixed) and shipped inside
the Arrow function; each Arrow batch then costs one matrix product.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from wattloom.fixed_values import DB4_LOW

LOW = np.array(DB4_LOW)
TAPS = len(LOW)


def max_level(n: int) -> int:
    """Deepest level at which the filter still fits n samples."""
    return 0 if n < TAPS - 1 else int(np.floor(np.log2(n / (TAPS - 1))))


def analyse(x: np.ndarray) -> np.ndarray:
    """One low-pass step along the last axis with mirrored ends."""
    n = x.shape[-1]
    m = (n + TAPS - 1) // 2
    e = (2 * np.arange(m)[:, None] + 1 - np.arange(TAPS)[None, :]) % (2 * n)
    e = np.where(e >= n, 2 * n - 1 - e, e)
    out = np.zeros((*x.shape[:-1], m))
    for j in range(TAPS):
        out += LOW[j] * x[..., e[:, j]]
    return out


def synthesise(a: np.ndarray, n: int) -> np.ndarray:
    """Low-pass reconstruction to n samples (the last one is surplus when n is odd)."""
    out = np.zeros((*a.shape[:-1], n))
    i = np.arange(n)
    for j in range(TAPS):
        # a[k] reaches sample 2k + 1 - j
        twice = i - 1 + j
        k = twice // 2
        hit = (twice % 2 == 0) & (k >= 0) & (k < a.shape[-1])
        out[..., i[hit]] += LOW[j] * a[..., k[hit]]
    return out


def smooth(x: np.ndarray, level: int) -> np.ndarray:
    """Trend of x (last axis): analyse ``level`` times, reconstruct without details."""
    lengths = []
    a = np.asarray(x, dtype=float)
    for _ in range(level):
        lengths.append(a.shape[-1])
        a = analyse(a)
    for n in reversed(lengths):
        a = synthesise(a, n)
    return a


@lru_cache(maxsize=8)
def smoothing_matrix(window: int, level: int) -> np.ndarray:
    """P with trend = P @ x for one window; the level is cut at what the window allows."""
    return smooth(np.eye(window), min(level, max_level(window))).T.copy()
