"""Spatial joins by grid cells, and filters built on them.

Distance joins become equi-joins on cells: the wider side's points are repeated
into the neighbouring cells that a search may reach.  Nearest points are found by
a k-d split (`kdtree`).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.kdtree import nearest
from cairn.sources.shared import checkpointed

AXES = "xyz"


def celled(points: DataFrame, cell: float) -> DataFrame:
    return points.withColumns({f"k{a}": F.floor(F.col(a) / F.lit(cell)).cast("long") for a in AXES})


def around(points: DataFrame, reach: int = 1) -> DataFrame:
    """`points` repeated into the (2 reach + 1)^3 cells about their own."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    out = points
    for a in AXES:
        out = out.withColumn("step", F.explode(steps)).withColumn(f"k{a}", F.col(f"k{a}") + F.col("step")).drop("step")
    return out


def _distance2(a: str, b: str):
    return functools.reduce(lambda s, t: s + t, ((F.col(f"{a}{x}") - F.col(f"{b}{x}")) * (F.col(f"{a}{x}") - F.col(f"{b}{x}")) for x in AXES))


def _pairs(queries: DataFrame, points: DataFrame, qid: str, pid: str, cell: float, reach: int) -> DataFrame:
    q = around(celled(queries.select(qid, *AXES), cell), reach).select(F.col(qid).alias("query_id"), *(F.col(a).alias(f"q{a}") for a in AXES), "kx", "ky", "kz")
    p = celled(points.select(pid, *AXES), cell).select(F.col(pid).alias("point_id"), *(F.col(a).alias(f"p{a}") for a in AXES), "kx", "ky", "kz")
    return q.join(p, ["kx", "ky", "kz"]).withColumn("d2", _distance2("q", "p"))


def within(queries: DataFrame, points: DataFrame, radius: float, *, qid: str = "id", pid: str = "id") -> DataFrame:
    """(query_id, point_id, d2) of all points at `radius` or less."""
    return _pairs(queries, points, qid, pid, radius, 1).where(F.col("d2") <= radius * radius).select("query_id", "point_id", "d2")


@dataclass(frozen=True)
class Index:
    """Points to search: what any spatial index offers, over tables of queries."""

    points: DataFrame
    id: str = "id"

    def count(self) -> int:
        return self.points.count()

    def nearest(self, queries: DataFrame, k: int = 1, *, exclude_self: bool = False) -> DataFrame:
        return nearest(queries, self.points, k, qid=self.id, pid=self.id, exclude_self=exclude_self)

    def within(self, queries: DataFrame, radius: float) -> DataFrame:
        return within(queries, self.points, radius, qid=self.id, pid=self.id)


def neighbour_means(points: DataFrame, *, pid: str, k: int = 6, cell: float = 0.1) -> DataFrame:
    """(pid, mean): the mean distance to at most k nearest others in the 27 cells around; points without any are left out."""
    ranked = nearest(points, points, k, qid=pid, pid=pid, exclude_self=True, cell=cell)
    return ranked.groupBy(F.col("query_id").alias(pid)).agg(F.avg(F.sqrt("d2")).alias("mean"))


def without_outliers(points: DataFrame, *, pid: str, k: int = 6, deviations: float = 1.5, cell: float = 0.1) -> DataFrame:
    """`points` whose mean neighbour distance is no more than mean + deviations x the population's deviation.

    Isolated points go; k + 1 points or fewer, or only isolated ones, all stay.
    """
    if points.limit(k + 2).count() <= k + 1:
        return points
    means = checkpointed(neighbour_means(points, pid=pid, k=k, cell=cell))
    bound = means.agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s"))
    if bound.first()["m"] is None:
        return points
    kept = means.crossJoin(F.broadcast(bound)).where(F.col("mean") <= F.col("m") + deviations * F.col("s"))  # one row
    return points.join(kept.select(pid), pid, "left_semi")


# --- planes -----------------------------------------------------------------

THICK, DENSE, FLOOR, PLANES, WIDEST, FEWEST = 0.05, 4, 10, 6, 8.0, 20


def heights(points: DataFrame) -> DataFrame:
    """(bin, n): points per slice of THICK in height."""
    return points.groupBy(F.floor(F.col("z") / F.lit(THICK)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def planes(points: DataFrame) -> DataFrame:
    """The PLANES fullest slices with DENSE points or more, lower ones first among equals: (bin, n, centre and extent)."""
    top = heights(points).where(F.col("n") >= DENSE).orderBy(F.desc("n"), "bin").limit(PLANES).withColumn("mid", (F.col("bin") + 0.5) * THICK)
    inside = points.join(F.broadcast(top), F.abs(F.col("z") - F.col("mid")) <= THICK / 2)  # PLANES rows
    box = inside.groupBy("bin", "mid").agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{n}_{a}") for a in "xy" for f, n in ((F.min, "lo"), (F.max, "hi")))).where(F.col("n") >= DENSE)
    for a in "xy":
        half = F.least(F.col(f"hi_{a}") - F.col(f"lo_{a}"), F.lit(WIDEST)) / 2
        mid = (F.col(f"hi_{a}") + F.col(f"lo_{a}")) / 2
        box = box.withColumns({f"lo_{a}": mid - half, f"hi_{a}": mid + half})
    return box


def plane_cells(points: DataFrame, resolution: float) -> DataFrame:
    """(bin, x, y, z): a grid over each plane wider than `resolution` both ways; none for FEWEST points or fewer."""
    if points.limit(FEWEST + 1).count() <= FEWEST:
        return points.sparkSession.createDataFrame([], "bin long, x double, y double, z double")
    box = planes(points).where(((F.col("hi_x") - F.col("lo_x")) > resolution) & ((F.col("hi_y") - F.col("lo_y")) > resolution))
    for a in "xy":
        box = box.withColumn(a, F.explode(F.sequence(F.lit(0), F.floor((F.col(f"hi_{a}") - F.col(f"lo_{a}")) / resolution).cast("int"))))
    return box.select("bin", (F.col("lo_x") + F.col("x") * resolution).alias("x"), (F.col("lo_y") + F.col("y") * resolution).alias("y"), F.col("mid").alias("z"))


def lowest_plane(points: DataFrame) -> DataFrame:
    """The height of the lowest slice with FLOOR points or more; null if there is none."""
    return heights(points).where(F.col("n") >= FLOOR).agg(((F.min("bin") + 0.5) * THICK).alias("z"))
