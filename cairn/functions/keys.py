"""Chunk keys, leaf indices and packed voxels.

On a one-metre cell whose corners are whole numbers, walking down an octree is
cutting bits off an integer: the leaf index is floor((x - chunk) * 32), its
ancestor at depth d the index shifted right by 5 - d, its centre
chunk + (index + 1/2) / 2^d.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.constants import DEPTH, LEAVES, SUPER

AXES = "xyz"


def chunk(c: Column) -> Column:
    """The chunk of a coordinate: its floor, within 16 bits."""
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(c))).cast("smallint")


def leaf(c: Column, key: Column) -> Column:
    """The leaf index within the chunk; null where the single-precision difference leaves [0, 1)."""
    local = c.cast("float") - key.cast("float")
    inside = (local >= F.lit(0.0).cast("float")) & (local < F.lit(1.0).cast("float"))
    return F.when(inside, F.floor(local * LEAVES)).cast("smallint")


def super_chunk(key: Column) -> Column:
    """The super-chunk of a chunk; rounds down also below zero."""
    return F.floor(key / F.lit(float(SUPER))).cast("smallint")


def ancestor(index: Column, depth: int) -> Column:
    return F.shiftright(index.cast("int"), DEPTH - depth).cast("smallint")


def centre(key: Column, index: Column, depth: Column | int = DEPTH) -> Column:
    """The centre of a node along an axis, exact in single precision."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    return key.cast("double") + (index.cast("double") + F.lit(0.5)) / F.pow(F.lit(2.0), d.cast("double"))


def octant(ix: Column, iy: Column, iz: Column) -> Column:
    """Which of its parent's eight children a node is: x one, y two, z four."""
    bit = lambda i: F.pmod(i.cast("int"), F.lit(2))
    return bit(ix) + 2 * bit(iy) + 4 * bit(iz)


def pack(r: Column, g: Column, b: Column, layer: Column, class_id: Column) -> Column:
    """Colour, layer and class in 32 bits, as a long without a sign."""
    parts = ((r, 24), (g, 16), (b, 8), (layer.cast("long").bitwiseAND(3), 6), (class_id.cast("long").bitwiseAND(63), 0))
    out = F.lit(0).cast("long")
    for c, shift in parts:
        out = out.bitwiseOR(F.shiftleft(c.cast("long"), shift))
    return out


def unpack(cf: Column) -> dict[str, Column]:
    """r, g, b, layer (an unknown one is structure) and class_id of a packed voxel."""
    bits = lambda shift, mask: F.shiftright(cf, shift).bitwiseAND(mask)
    layer = bits(6, 3)
    return {"r": bits(24, 255), "g": bits(16, 255), "b": bits(8, 255), "layer": F.when(layer <= 2, layer).otherwise(0), "class_id": bits(0, 63)}


def lod(distance: Column) -> Column:
    """The depth that a chunk at this distance is shown at."""
    from cairn.constants import BANDS

    out = F
    for most, depth in BANDS:
        out = out.when(distance < most, depth)
    return out.otherwise(1)
