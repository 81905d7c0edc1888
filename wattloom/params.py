"""Operator parameters. Every operator takes them as arguments; nothing reads a global."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # split
    train_frac: float = 0.85
    min_len: int = 720
    # windows
    backcast: int = 168
    forecast: int = 24
    stride: int = 24
    period: int = 24
    wavelet_level: int = 5
    max_windows_per_file: int = 200_000
    # labels
    q_low: float = 0.01
    q_high: float = 0.99
    merge_rule: str = "any"
    # folds
    n_folds: int = 4
    initial_frac: float = 0.80
    val_horizon: int = 24
    train_span: int = 24 * 90
    val_frac: float = 0.15
    seed: int = 42
    lambda_cls: float = 1.0
    # physical: rows of one building kept together while ordering / windowing
    order_span_seconds: int = 65_536 * 3600
    block_strides: int = 64

    @property
    def window(self) -> int:
        return self.backcast + self.forecast

    @property
    def block(self) -> int:
        """Rows per window block: a whole number of strides, at least one halo long."""
        halo_strides = -(-self.window // self.stride)
        return self.stride * max(self.block_strides, halo_strides)

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)


DEFAULT = Params()
