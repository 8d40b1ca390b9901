"""Labels and short forms of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of enumerations by their wire values; whatever else has no name.
CAMERA_LABELS = {0: "Wide", 1: "Ultra-Wide", 2: "Dog"}
LAYERS = {0: "structure", 1: "furniture", 2: "dynamic"}


def label(code: Column, names: dict[int, str], other: str) -> Column:
    out = F
    for k, v in names.items():
        out = out.when(code == k, v)
    return out.otherwise(other)


def tenths(x: Column) -> Column:
    """`x` of 1 or more, up to 10^13, with one decimal, rounded by its exact value as C's printf does: of ties, which only .25 and .75 are, to the even digit.

    (16 x - m) + 4 x is 20 x - m without rounding, so its sign tells on which side of the middle m / 20 x lies.
    """
    x = x.cast("double")
    low = F.floor(x * 10)
    side = (x * 16 - (low * 2 + 1)) + x * 4
    t = low + F.when((side > 0) | ((side == 0) & (low % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def short_count(n: Column) -> Column:
    """1234567 as 1.2M, 1234 as 1.2K."""
    return (
        F.when(n >= 1_000_000, F.concat(tenths(n / 1e6), F.lit("M")))
        .when(n >= 1_000, F.concat(tenths(n / 1e3), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def minutes(seconds: Column) -> Column:
    """Seconds as m:ss."""
    s = seconds.cast("int")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def fraction(done: Column, total: Column) -> Column:
    """The share that is done; null where the total is not known."""
    return F.when(total > 0, done / total)


def remaining(done: Column, total: Column, rate: Column) -> Column:
    """Seconds left at the present rate; null where either is not known."""
    return F.when((total > 0) & (rate > 0), (total - done) / rate)
