"""Colour functions of pixels, as columns. A key is a constant (r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Key = tuple[int, int, int]
RGB = ("r", "g", "b")


def distance_sq(key: Key) -> Column:
    return sum((F.col(c) - k) * (F.col(c) - k) for c, k in zip(RGB, key, strict=True))


def distance(key: Key) -> Column:
    return F.sqrt(distance_sq(key).cast("double"))


def _sides(key: Key) -> tuple[list[str], list[str]]:
    return [c for c, k in zip(RGB, key, strict=True) if k >= 192], [c for c, k in zip(RGB, key, strict=True) if k < 64]


def _mean(columns: list[str]) -> Column:
    return sum(F.col(c) for c in columns).cast("double") / len(columns)


def key_tint(key: Key) -> Column:
    """How far the key's strong channels stand above its weak ones; 0 if the key has not both."""
    keyed, unkeyed = _sides(key)
    return _mean(keyed) - _mean(unkeyed) if keyed and unkeyed else F.lit(0.0)


def neutralise(key: Key) -> dict[str, Column]:
    """Keyed channels held down to the rounded mean of the others."""
    keyed, unkeyed = _sides(key)
    level = F.rint(_mean(unkeyed if keyed and unkeyed else list(RGB))).cast("int")
    return {c: F.least(F.col(c), level) if c in keyed else F.col(c) for c in RGB}


def smoothstep(low: float, high: float, value: Column) -> Column:
    if high <= low:
        return F.when(value >= high, 1.0).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return t * t * (3.0 - 2.0 * t)


def soft_alpha(d: Column, threshold: float, fringe: float) -> Column:
    """Alpha after edge softening; halves round to even."""
    soft = F.rint(F.col("a") * smoothstep(threshold, fringe, d)).cast("int")
    return F.when((F.col("a") <= 16) | (d <= threshold), 0).when(d >= fringe, F.col("a")).otherwise(soft)


def chroma_candidate(key: Key, threshold: float = 96.0, fringe: float = 180.0, delta: float = 18.0) -> Column:
    d = distance_sq(key)
    return (F.col("a") <= 16) | (d <= threshold * threshold) | ((d <= fringe * fringe) & (key_tint(key) >= delta))


def visible_magenta(alpha: int = 24, red: int = 150, blue: int = 150, green: int = 96, red_delta: int = 70, blue_delta: int = 70) -> Column:
    r, g, b, a = (F.col(c) for c in "rgba")
    return (a >= alpha) & (r >= red) & (b >= blue) & (g <= green) & (r - g >= red_delta) & (b - g >= blue_delta)


def vfx_signal() -> Column:
    r, g, b, a = (F.col(c) for c in "rgba")
    top = F.greatest(r, g, b)
    cool, hot = (b >= 140) & (g >= 96) & (b >= r + 18), (r >= 150) & (g >= 80) & (r >= b + 18)
    return (a > 16) & (cool | hot | ((top >= 128) & (top - F.least(r, g, b) >= 48)))


def hsv() -> tuple[Column, Column, Column]:
    """Hue, saturation and value from 0 to 255, cut off to integers."""
    r, g, b = (F.col(c) for c in RGB)
    top, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    wide = F.greatest(span, F.lit(1)).cast("double")
    h = F.when(r == top, (g - b) / wide).when(g == top, 2.0 + (b - r) / wide).otherwise(4.0 + (r - g) / wide) / 6.0
    hue = F.when(span == 0, 0).otherwise(F.floor((h - F.floor(h)) * 255.0)).cast("int")
    return hue, F.floor(span * 255.0 / F.greatest(top, F.lit(1))).cast("int"), top


def limb() -> Column:
    """Which limb a pixel's colour band stands for; null for dull or dark pixels."""
    h, s, v = hsv()
    return F.when((s < 70) | (v < 65), None).when((h <= 14) | (h >= 244), "red_arm").when(h <= 43, "orange_leg").when(h <= 112, "green_leg").when(h <= 190, "blue_arm")


def hex_rgb(code: Column) -> tuple[Column, Column, Column]:
    """Channels of ``#RRGGBB``; null for anything else."""
    good = code.rlike("^#[0-9a-fA-F]{6}$")
    return tuple(F.when(good, F.conv(F.substring(code, p, 2), 16, 10).cast("int")) for p in (2, 4, 6))


def luminance(r: Column, g: Column, b: Column) -> Column:
    def linear(c: Column) -> Column:
        x = c / 255.0
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def blend(mode: str, under: Column, over: Column) -> Column:
    """One channel of two opaque layers."""
    if mode == "screen":
        return F.lit(255) - F.floor((255 - under) * (255 - over) / 255.0).cast("int")
    if mode == "multiply":
        return F.floor(under * over / 255.0).cast("int")
    if mode == "add":
        return F.least(F.lit(255), under + over)
    return over
