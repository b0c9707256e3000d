"""Column expressions on pixels: light, colour buckets, alpha."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .manifest import half_up


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def chroma(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def color_bucket(r: Column, g: Column, b: Column) -> Column:
    """The top four bits of each channel, packed."""
    top = lambda c: F.shiftright(c.cast("int"), 4)
    return top(r) + top(g) * 16 + top(b) * 256


def polish_alpha(alpha: Column, fine: Column) -> Column:
    """Contrast curve on alpha 0..255, gentler where detail is fine."""
    n = alpha / 255
    curve = lambda low, high, p: F.when(n <= low, 0).when(n >= high, 255).otherwise(half_up(F.pow(n, F.lit(p)) / (F.pow(n, F.lit(p)) + F.pow(1 - n, F.lit(p))) * 255)).cast("int")
    return F.when(fine, curve(0.003, 0.997, 2.2)).otherwise(curve(0.015, 0.985, 4.0))


def merge_alpha(polished: Column, source_alpha: Column) -> Column:
    return half_up(polished * source_alpha / 255).cast("int")
