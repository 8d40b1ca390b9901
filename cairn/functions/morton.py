"""Morton keys: one long for a voxel, neighbours in space near each other in order.

An axis has 21 bits, the chunk's 16 (from the least chunk on) above the leaf's
5; the key takes a bit of each axis in turn, x lowest.  Cutting 15 bits off
gives the chunk, cutting 27 the super-chunk, so a sort by key is a sort by all
levels of the octree at once, and a region of space is a few ranges of keys.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.constants import DEPTH, LEAVES

#: Bits of an axis, the chunk coordinate that counts as zero, and the bits below a chunk and a super-chunk.
BITS, ORIGIN = 21, 32768
CHUNK_BITS, SUPER_BITS = 3 * DEPTH, 3 * (DEPTH + 4)
#: Ranges of keys that a region is cut into at most; what they hold too much, the exact test drops.
RANGES = 64
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
Ranges = list[tuple[int, int]]
Relation = Callable[[Sequence[float], Sequence[float]], int]


def _table(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _spread(u: Column) -> Column:
    """Two zero bits between the bits of `u`, seven at a time by a table (shifts and masks would repeat `u` at every step)."""
    spaced = _table([sum((v >> k & 1) << 3 * k for k in range(7)) for v in range(128)])
    out = F.lit(0).cast("long")
    for n in range(0, BITS, 7):
        part = F.element_at(spaced, (F.shiftright(u, n).bitwiseAND(F.lit(127)) + 1).cast("int"))
        out = out.bitwiseOR(F.shiftleft(part, 3 * n))
    return out


def _gathered(u: Column) -> Column:
    """Every third bit of `u`, from the lowest on, three at a time."""
    close = _table([sum((v >> 3 * k & 1) << k for k in range(3)) for v in range(512)])
    out = F.lit(0).cast("long")
    for n in range(0, BITS, 3):
        part = F.element_at(close, (F.shiftright(u, 3 * n).bitwiseAND(F.lit(511)) + 1).cast("int"))
        out = out.bitwiseOR(F.shiftleft(part, n))
    return out


def key(prefix: str = "") -> Column:
    """The key of the voxel in the columns cx .. iz."""
    code = F.lit(0).cast("long")
    for bit, a in enumerate("xyz"):
        axis = F.shiftleft(F.col(f"{prefix}c{a}").cast("long") + ORIGIN, DEPTH).bitwiseOR(F.col(f"{prefix}i{a}").cast("long"))
        code = code.bitwiseOR(F.shiftleft(_spread(axis), bit))
    return code


def keys(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of points in metres, and which points have one (see `functions.keys`: those that rounding puts outside their chunk don't)."""
    code, inside = np.zeros(len(x), np.uint64), np.ones(len(x), bool)
    for bit, c in enumerate((x, y, z)):
        corner = np.clip(np.floor(c), -ORIGIN, ORIGIN - 1)
        local = c.astype(np.float32) - corner.astype(np.float32)
        inside &= (local >= 0) & (local < 1)
        leaf = np.where(inside, np.floor(local * np.float32(LEAVES)), 0).astype(np.uint64)
        u = (np.where(inside, corner, 0).astype(np.int64) + ORIGIN).astype(np.uint64) << np.uint64(DEPTH) | leaf
        for shift, mask in _SPREAD:
            u = (u | u << np.uint64(shift)) & np.uint64(mask)
        code |= u << np.uint64(bit)
    return code.astype(np.int64), inside


def corners(code: np.ndarray) -> dict[str, np.ndarray]:
    """cx .. iz of keys."""
    out = {}
    for bit, a in enumerate("xyz"):
        u = code.astype(np.uint64) >> np.uint64(bit) & np.uint64(_SPREAD[-1][1])
        for (shift, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [(1 << BITS) - 1], strict=True):
            u = (u | u >> np.uint64(shift)) & np.uint64(mask)
        axis = u.astype(np.int64)
        out[f"c{a}"], out[f"i{a}"] = ((axis >> DEPTH) - ORIGIN).astype(np.int16), (axis & LEAVES - 1).astype(np.int16)
    return out


def located(df: DataFrame, name: str = "key") -> DataFrame:
    """`df` with cx .. iz of the key in the column `name`."""
    new = {}
    for bit, a in enumerate("xyz"):
        axis = _gathered(F.shiftright(F.col(name), bit))
        new[f"c{a}"] = (F.shiftright(axis, DEPTH) - ORIGIN).cast("smallint")
        new[f"i{a}"] = axis.bitwiseAND(F.lit(LEAVES - 1)).cast("smallint")
    return df.withColumns({c: new[c] for c in ("cx", "cy", "cz", "ix", "iy", "iz")})


def super_key(name: str = "key") -> Column:
    """The super-chunk of a key, as the key's upper bits."""
    return F.shiftright(F.col(name), SUPER_BITS)


def _corner(code: int, level: int) -> list[float]:
    """The least corner, in metres, of the cell `code` whose side is 2 ** level leaves."""
    out = []
    for bit in range(3):
        u = sum((code >> (3 * k + bit) & 1) << k for k in range(BITS - level))
        out.append((u << level) / LEAVES - ORIGIN)
    return out


def ranges(relation: Relation, most: int = RANGES) -> Ranges:
    """Ranges of keys, both ends included, that hold every leaf of a region, `most` at most.

    relation(least corner, greatest corner) tells of a box: -1 if it lies
    outside, 1 if it lies inside, 0 if it may be cut.  The largest cut cells are
    split first, for as long as their pieces fit.
    """
    whole: Ranges = []
    cut = [(-BITS, 0)]  # largest first

    def sort_out(code: int, level: int) -> None:
        low = _corner(code, level)
        side = (1 << level) / LEAVES
        of = relation(low, [c + side for c in low])
        if of > 0 or (of == 0 and not level):
            whole.append((code << 3 * level, ((code + 1) << 3 * level) - 1))
        elif of == 0:
            heapq.heappush(cut, (-level, code))

    while cut and len(joined(whole + [(c << -3 * n, (c + 1 << -3 * n) - 1) for n, c in cut])) <= most:
        before = list(whole), list(cut)
        level, code = heapq.heappop(cut)
        for child in range(8):
            sort_out(code << 3 | child, -level - 1)
        if len(joined(whole + [(c << -3 * n, (c + 1 << -3 * n) - 1) for n, c in cut])) > most:
            whole, cut = before
            break
    return joined(whole + [(c << -3 * n, (c + 1 << -3 * n) - 1) for n, c in cut])


def joined(parts: Ranges) -> Ranges:
    """`parts` in order, those that touch as one."""
    out: Ranges = []
    for a, z in sorted(parts):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def box(low: Sequence[float], high: Sequence[float]) -> Relation:
    """The relation of boxes to the box between two corners, both included."""

    def of(a: Sequence[float], z: Sequence[float]) -> int:
        if any(y < p or x > q for x, y, p, q in zip(a, z, low, high, strict=True)):
            return -1
        return int(all(x >= p and y <= q for x, y, p, q in zip(a, z, low, high, strict=True)))

    return of


def sphere(centre: Sequence[float], radius: float) -> Relation:
    def of(a: Sequence[float], z: Sequence[float]) -> int:
        near = sum(max(x - c, 0.0, c - y) ** 2 for x, y, c in zip(a, z, centre, strict=True))
        far = sum(max(abs(x - c), abs(y - c)) ** 2 for x, y, c in zip(a, z, centre, strict=True))
        return -1 if near > radius * radius else int(far <= radius * radius)

    return of


def frustum(planes: Sequence[tuple[float, float, float, float]]) -> Relation:
    """The relation to the points that no plane (a, b, c, d) has on its negative side, as a x + b y + c z + d."""

    def of(a: Sequence[float], z: Sequence[float]) -> int:
        inside = 1
        for *n, d in planes:
            if sum(c * (y if c >= 0 else x) for c, x, y in zip(n, a, z, strict=True)) + d < 0:
                return -1
            if sum(c * (x if c >= 0 else y) for c, x, y in zip(n, a, z, strict=True)) + d < 0:
                inside = 0
        return inside

    return of


def both(*relations: Relation) -> Relation:
    """The relation to what lies in all regions."""
    return lambda a, z: min(r(a, z) for r in relations) if all(r(a, z) >= 0 for r in relations) else -1


def whole_chunks(relation: Relation) -> Relation:
    """The relation to all chunks that `relation` doesn't place outside, each as a whole."""

    def of(a: Sequence[float], z: Sequence[float]) -> int:
        if z[0] - a[0] > 1:
            return min(relation(a, z), 0)  # a corner of its box may be shown where a chunk within isn't
        low = [math.floor(x) for x in a]
        return -1 if relation(low, [c + 1 for c in low]) < 0 else 1

    return of


def within(parts: Ranges, name: str = "key") -> Column:
    """Whether a key lies in one of the ranges; comparisons that readers of sorted files skip row groups by."""
    out = F.lit(False)
    for k, (a, z) in enumerate(parts):
        one = F.col(name).between(a, z)
        out = one if not k else out | one
    return out
