"""Lookups in rasters that are held as arrays or bytes, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def depth_at(depths: Column, width: Column, height: Column, x: Column, y: Column, metres: float = 1.0) -> Column:
    """The depth of a pixel in metres; not a number outside the raster."""
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return F.when(inside, F.element_at(depths, (y * width + x + 1).cast("int")).cast("double") * metres).otherwise(F.lit(float("nan")))


def byte_at(data: Column, at: Column) -> Column:
    """A byte of a binary column, without a sign."""
    return F.conv(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


def nv12_at(luma: Column, chroma: Column, stride: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Luma and both chroma samples of a pixel; chroma has half the resolution, its two samples side by side."""
    at = F.floor(y / 2) * stride + F.floor(x / 2) * 2
    return byte_at(luma, y * stride + x), byte_at(chroma, at), byte_at(chroma, at + 1)


def bgra_at(data: Column, stride: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a pixel."""
    at = y * stride + x * 4
    return byte_at(data, at + 2), byte_at(data, at + 1), byte_at(data, at)


def calibrated(known: Column, estimated: Column, before: float = 1.0) -> Column:
    """Metres per unit of depth from a known distance; as before where the estimate isn't positive."""
    return F.when(estimated > 0, known / estimated).otherwise(F.lit(before))
