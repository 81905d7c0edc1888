"""Scalar column expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.fixed_values import UNIT_BYTES


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """Number or null, for any input type."""
    return null_if_nan(c.try_cast("double"))


def to_time(c: Column) -> Column:
    """Timestamp without zone or null, for text and time types; text of eight digits is a date."""
    compact = F.try_to_timestamp(F.regexp_extract(c.cast("string"), r"^\s*(\d{8})\s*$", 1), F.lit("yyyyMMdd"))
    return F.coalesce(c.try_cast("timestamp_ntz"), compact.cast("timestamp_ntz"))


def safe_name(c: Column) -> Column:
    cleaned = F.regexp_replace(c.cast("string"), r"(?U)[^\w\-.]+", "_")
    return F.coalesce(F.nullif(F.trim(cleaned, F.lit("_")), F.lit("")), F.lit("unnamed"))


def loose_number(c: Column) -> Column:
    """"1,234" -> 1234.0; anything unreadable -> null."""
    return null_if_nan(F.trim(F.regexp_replace(c.cast("string"), ",", "")).try_cast("double"))


def us_date(c: Column) -> Column:
    """M/d/yyyy, then M/d/yy, else null."""
    text = c.cast("string")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("M/d/yyyy")), F.try_to_timestamp(text, F.lit("M/d/yy"))
    ).cast("timestamp_ntz")


def md5_mod(c: Column, m: int) -> Column:
    """md5(c) as a 128-bit number modulo m, folded from three hexadecimal pieces."""
    digest = F.md5(c.cast("string"))

    def piece(start: int, length: int) -> Column:
        return F.conv(F.substring(digest, start, length), 16, 10).cast("long") % F.lit(m)

    return (
        piece(1, 15) * F.lit(pow(16, 17, m)) + piece(16, 15) * F.lit(pow(16, 2, m)) + piece(31, 2)
    ) % F.lit(m)


def seeded_order(*cols: Column, seed: int) -> Column:
    """Pseudo-random but repeatable sort key of a row."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))))


def unit_to_gb(value: Column, unit: Column) -> Column:
    factor = F.create_map(*[F.lit(x) for kv in UNIT_BYTES.items() for x in kv])
    scale = F.coalesce(F.try_element_at(factor, unit), F.lit(1)).cast("double")
    return value.try_cast("double") * scale / F.lit(float(2**30))


def duration_seconds(c: Column) -> Column:
    """"1h02m03s", "5m02s", "27.0s" -> seconds; null when no part is present."""
    pattern = r"^(?:(\d+)h)?(?:(\d+)m)?(?:([\d.]+)s)?"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("double")

    h, m, s = part(1), part(2), part(3)
    seen = h.isNotNull() | m.isNotNull() | s.isNotNull()
    zero = F.lit(0.0)
    return F.when(seen, F.coalesce(h, zero) * 3600 + F.coalesce(m, zero) * 60 + F.coalesce(s, zero))


def _whole(c: Column) -> Column:
    return F.floor(c).cast("long")


def duration_text(seconds: Column) -> Column:
    """Seconds -> "1h02m03s", "4m05s" or "6.7s"."""
    s = _whole(seconds)
    long_form = F.format_string("%dh%02dm%02ds", _whole(s / 3600), _whole((s % 3600) / 60), s % 60)
    mid_form = F.format_string("%dm%02ds", _whole(s / 60), s % 60)
    return F.when(seconds >= 3600, long_form).when(seconds >= 60, mid_form).otherwise(
        F.format_string("%.1fs", seconds)
    )


def duration_days_text(seconds: Column) -> Column:
    """Seconds -> "1d02h03m", "2h03m" or "3m"; "?" when negative."""
    s = _whole(seconds)
    d, h, m = _whole(s / 86400), _whole((s % 86400) / 3600), _whole((s % 3600) / 60)
    return (
        F.when(seconds < 0, F.lit("?"))
        .when(d > 0, F.format_string("%dd%02dh%02dm", d, h, m))
        .when(h > 0, F.format_string("%dh%02dm", h, m))
        .otherwise(F.format_string("%dm", m))
    )


def window_count(n: Column, window: int, stride: int) -> Column:
    """How many whole windows a series of n rows has."""
    return F.when(n < window, F.lit(0).cast("long")).otherwise(
        F.floor((n - F.lit(window)) / F.lit(stride)).cast("long") + 1
    )


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, or 0 when b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def dynamic_loss(trend: Column, season: Column) -> Column:
    """Each part weighted by the other's share; 0 when both are 0."""
    total = trend + season
    return F.when(total == 0, F.lit(0.0)).otherwise(
        (season / total) * trend + (trend / total) * season
    )


def huber(error: Column, delta: float = 1.0) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta))


def bce(prob: Column, label: Column, pos_weight: Column | float = 1.0) -> Column:
    """Binary cross-entropy of a probability; the logarithms are cut at -100."""
    w = F.lit(pos_weight) if not isinstance(pos_weight, Column) else pos_weight
    log_p = F.when(prob <= 0, F.lit(-100.0)).otherwise(F.greatest(F.ln(prob), F.lit(-100.0)))
    log_q = F.when(prob >= 1, F.lit(-100.0)).otherwise(F.greatest(F.ln(1 - prob), F.lit(-100.0)))
    return -(w * label * log_p + (1 - label) * log_q)


def unscale(p: Column, mean: Column, std: Column, eps: float = 1e-8) -> Column:
    return p * (std + F.lit(eps)) + mean


def halving_rate(epoch: Column, start: float) -> Column:
    return F.lit(start) * F.pow(F.lit(0.5), epoch - 1)
