"""Colour conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heights up to which a colour holds, and the colour above all.
HEIGHT_BANDS = ((-0.15, (220, 40, 40)), (0.04, (80, 100, 160)), (0.45, (55, 185, 90)), (1.1, (225, 185, 45)), (2.0, (220, 90, 45)))
ABOVE = (110, 120, 210)


def height_colour(z: Column, channel: int) -> Column:
    """One channel (0 red, 1 green, 2 blue) of the colour of a height."""
    out = F
    for most, rgb in HEIGHT_BANDS:
        out = out.when(z < most, rgb[channel])
    return out.otherwise(ABOVE[channel])


def _byte(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int")))


def studio_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Bytes from studio-range luma and chroma by rounded coefficients; cuts towards zero."""
    l, u, v = F.lit(1.164) * (y - 16), cb - 128, cr - 128
    return _byte(l + 1.596 * v), _byte(l - 0.392 * u - 0.813 * v), _byte(l + 2.017 * u)


def shader_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Values in 0..1 from samples in 0..1, as a fragment program computes them."""
    l, u, v = (y - 16.0 / 255.0) * (255.0 / 219.0), cb - 0.5, cr - 0.5
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return clamp(l + 1.402 * v), clamp(l - 0.344136 * u - 0.714136 * v), clamp(l + 1.772 * u)


def hsv_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue in 0..1 of a hue, saturation and value in 0..1."""

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6.0, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))

    return channel(5), channel(3), channel(1)
