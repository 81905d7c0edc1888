"""Building blocks of the SQL twins."""

from __future__ import annotations

from wattloom.fixed_values import DB4_LOW
from wattloom.functions.wavelet import TAPS, max_level
from wattloom.params import Params


# Exact halves would round either way with the last bit of a sum; both sides shift off them equally.
OFF_HALF = 1.37e-3


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr} + {OFF_HALF * 10.0**-digits:.3e}, {digits}) + 0.0)"


def windows_sql(p: Params, source: str = "series", value: str = "energy") -> str:
    """CTEs ``wins`` (one row per window) and ``pts`` (one row per window and position)."""
    return f"""
wins AS (
  SELECT grp, building, n, unnest(range(0, n - {p.window} + 1, {p.stride})) AS start
  FROM (SELECT DISTINCT grp, building, n FROM {source} WHERE n >= {p.window})),
pts AS (
  SELECT w.grp, w.building, w.n, w.start, s.t - w.start AS pos, s.t, coalesce(s.{value}, 0) AS x
  FROM wins w JOIN {source} s ON s.grp = w.grp AND s.building = w.building
   AND s.t >= w.start AND s.t < w.start + {p.window})"""


def smoother_sql(window: int, level: int) -> str:
    """CTE ``smoother(i, k, w)``: the smoothing matrix from the eight taps, level by level."""
    level = min(level, max_level(window))
    lengths = [window]
    for _ in range(level):
        lengths.append((lengths[-1] + TAPS - 1) // 2)
    taps = ", ".join(f"({j}, {h!r}::DOUBLE)" for j, h in enumerate(DB4_LOW))
    ctes = [f"taps(j, h) AS (VALUES {taps})"]
    for lv in range(1, level + 1):
        n, m = lengths[lv - 1], lengths[lv]
        ctes.append(f"""
ana{lv} AS (
  SELECT k, CASE WHEN e >= {n} THEN {2 * n - 1} - e ELSE e END AS x, sum(h) AS w
  FROM (SELECT k, ((2 * k + 1 - j) % {2 * n} + {2 * n}) % {2 * n} AS e, h
        FROM range({m}) r(k), taps) GROUP BY 1, 2),
syn{lv} AS (
  SELECT 2 * k + 1 - j AS i, k, h AS w FROM range({m}) r(k), taps
  WHERE 2 * k + 1 - j >= 0 AND 2 * k + 1 - j < {n})""")
        if lv == 1:
            ctes.append("down1 AS (SELECT k, x, w FROM ana1)")
        else:
            ctes.append(
                f"down{lv} AS (SELECT a.k, d.x, sum(a.w * d.w) AS w FROM ana{lv} a "
                f"JOIN down{lv - 1} d ON a.x = d.k GROUP BY 1, 2)"
            )
    prev = f"down{level}"
    for lv in range(level, 0, -1):
        ctes.append(
            f"up{lv} AS (SELECT s.i AS k, d.x, sum(s.w * d.w) AS w FROM syn{lv} s JOIN {prev} d ON s.k = d.k GROUP BY 1, 2)"
        )
        prev = f"up{lv}"
    ctes.append(f"smoother AS (SELECT k AS i, x AS k, w FROM {prev})")
    return ",\n".join(ctes)


def trend_sql(p: Params) -> str:
    """CTE ``parts``: x, trend and season per window position."""
    return f"""
{smoother_sql(p.window, p.wavelet_level)},
trends AS (
  SELECT grp, building, start, m.i AS pos, sum(m.w * x) AS trend
  FROM pts JOIN smoother m ON m.k = pts.pos GROUP BY 1, 2, 3, 4),
parts AS (
  SELECT p.*, trend, x - trend AS season FROM pts p JOIN trends USING (grp, building, start, pos))"""


def labels_sql(p: Params) -> str:
    """CTE ``labels``: one row per window position with its label and the window's limits."""
    return f"""
resid AS (SELECT *, round(x - trend, 9) AS res FROM parts),
limits AS (
  SELECT grp, building, start, quantile_cont(res, {p.q_low}) AS lo, quantile_cont(res, {p.q_high}) AS hi
  FROM resid GROUP BY 1, 2, 3),
labels AS (
  SELECT resid.*, lo, hi, (res < lo OR res > hi)::INT AS label FROM resid JOIN limits USING (grp, building, start))"""


def fused_sql(merge_rule: str = "any") -> str:
    test = "sum(label) > 0" if merge_rule == "any" else "sum(label)::DOUBLE / count(*) > 0.5"
    return f"""
fused AS (
  SELECT grp, building, t, arg_min(x, start) AS energy, sum(label)::BIGINT AS votes, count(*) AS cover,
         ({test})::INT AS anomaly
  FROM labels GROUP BY 1, 2, 3)"""
