"""Order-dependent operators over a session's frames, as folds over its sorted steps.

Paths are sums over ranges of a session.  For scales, ticks and keyframes a
session's rows meet in one task; sessions are bounded by a recording's length and
spread over tasks by their key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.shared import checkpointed

#: Smoothing of a position, shift per pixel of flow, pixels of flow that count, and yaw per radian of lateral flow.
SMOOTH, PER_PIXEL, STILL, YAW, TURNING = 0.85, 0.002, 0.05, 0.003, 0.5
#: Ratios that a scale keeps, how many it needs, the factors of it that a new one may have, and displacements too small.
KEPT, ENOUGH, LOW, HIGH, TINY = 20, 5, 0.33, 3.0, 0.01


def steps(by: str, *columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(by).alias("_at"), *columns)))


def every(rows: DataFrame, n: int, by: str = "seq", session: str = "session") -> DataFrame:
    """Each n-th row of a session, the n-th first."""
    rn = F.row_number().over(Window.partitionBy(session).orderBy(by))
    return rows.withColumn("rn", rn).where(F.col("rn") % n == 0).drop("rn")


def scanned(rows: DataFrame, value: str, session: str = "session", by: tuple[str, ...] = ("seq",), name: str = "before") -> DataFrame:
    """`rows` with the sum of `value` over the session's rows before each, in order of `by`.

    Rows are dealt by ranges of session and order, so that a session of any
    length lies in many tasks; sums run within a range, and a row a range and
    session, in order, carries them on.
    """
    rows = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), session, *by)
    placed = checkpointed(rows.withColumn("_range", F.spark_partition_id()))
    earlier = (Window.unboundedPreceding, -1)
    within = Window.partitionBy(session, "_range").orderBy(*by).rowsBetween(*earlier)
    sums = placed.groupBy(session, "_range").agg(F.sum(value).alias("_sum"))
    upto = F.coalesce(F.sum("_sum").over(Window.partitionBy(session).orderBy("_range").rowsBetween(*earlier)), F.lit(0.0))
    carried = sums.select(F.col(session).alias("_session"), F.col("_range").alias("_of"), upto.alias("_upto"))
    inner = placed.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0.0)))
    out = inner.join(carried, F.col(session).eqNullSafe(F.col("_session")) & (F.col("_range") == F.col("_of")))
    return out.withColumn(name, F.col("_upto") + F.col("_within")).drop("_range", "_session", "_of", "_upto", "_within")


def smoothed_path(deltas: DataFrame) -> DataFrame:
    """(session, x, y, z, heading): the position after all of a session's flow (seq, dx, dy, magnitude).

    Headings turn about the vertical axis only.  Smoothing keeps SMOOTH of the
    old position and takes the rest of the moved one, so a step adds 1 - SMOOTH
    of its turned delta: the heading is a sum over the steps before, the path a
    sum of steps, and no session meets in one task.  Steps that are STILL count
    for nothing; a session of such steps stays at zero.
    """
    lateral2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    moves = F.col("magnitude") > STILL
    turn = F.when(moves & (F.sqrt(lateral2) > TURNING), F.atan2("dy", "dx") * YAW).otherwise(0.0)
    steps_ = scanned(deltas.select("session", "seq", "dx", "dy", "magnitude", turn.alias("turn")), "turn", by=("seq", "dx", "dy", "magnitude"), name="heading")
    lx, ly = F.col("dx") * PER_PIXEL, -F.col("dy") * PER_PIXEL
    lz = F.sqrt(F.greatest(F.lit(0.0), F.col("magnitude") * F.col("magnitude") - lateral2)) * PER_PIXEL
    c, s = F.cos("heading"), F.sin("heading")
    moved = {"x": c * lx + s * lz, "y": ly, "z": c * lz - s * lx}
    total = lambda v: F.sum(F.when(moves, (1 - SMOOTH) * v).otherwise(0.0))
    return steps_.groupBy("session").agg(*(total(v).alias(n) for n, v in moved.items()), F.sum("turn").alias("heading"))


def scales(samples: DataFrame) -> DataFrame:
    """(session, scale, samples, converged) from samples (seq, known, visual): the upper median of the last KEPT accepted ratios.

    A ratio under LOW or over HIGH times the scale so far is dropped, as is one
    whose visual displacement is tiny; the scale is 1 before any.
    """

    def fold(a: Column, e: Column) -> Column:
        ratio = e["known"] / e["visual"]
        ok = (e["visual"] > TINY) & ((F.size(a["kept"]) == 0) | ((ratio >= LOW * a["scale"]) & (ratio <= HIGH * a["scale"])))
        longer = F.concat(a["kept"], F.array(ratio))
        kept = F.slice(longer, F.greatest(F.lit(1), F.size(longer) - KEPT + 1), KEPT)
        median = F.element_at(F.array_sort(kept), (F.floor(F.size(kept) / 2) + 1).cast("int"))
        return F.when(ok, F.struct(kept.alias("kept"), median.alias("scale"))).otherwise(a)

    zero = F.struct(F.expr("cast(array() as array<double>)").alias("kept"), F.lit(1.0).alias("scale"))
    got = samples.groupBy("session").agg(F.aggregate(steps("seq", "known", "visual"), zero, fold).alias("s"))
    return got.select("session", "s.scale", F.size("s.kept").alias("samples"), (F.size("s.kept") >= ENOUGH).alias("converged"))


def ticks(frames: DataFrame, period: float = 0.25) -> DataFrame:
    """(session, tick, at, frames, fps): a tick at the first frame `period` or more after the last one; `frames`: session, t in seconds."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(rows["t"].to_numpy(float))
        out, since, seen = [], 0.0, 0
        while True:
            at = max(seen, int(np.searchsorted(t, since + period)) - 1)  # the sum may be rounded, the difference decides
            while at < len(t) and t[at] - since < period:
                at += 1
            if at >= len(t):
                break
            out.append((key[0], len(out), t[at], at + 1 - seen, (at + 1 - seen) / (t[at] - since)))
            since, seen = t[at], at + 1
        return pd.DataFrame(out, columns=["session", "tick", "at", "frames", "fps"])

    return frames.groupBy("session").applyInPandas(work, f"session {dict(frames.dtypes)['session']}, tick long, at double, frames int, fps double")


def deltas(samples: DataFrame, value: str, by: str = "seq", key: str = "session") -> DataFrame:
    """`samples` with the change of `value` since the sample before, null for the first."""
    w = Window.partitionBy(key).orderBy(by)
    return samples.withColumn("delta", F.col(value) - F.lag(value).over(w))


#: Metres of travel and frames after which a keyframe is due.
TRAVEL, FRAMES = 0.15, 30


def keyframes(deltas_: DataFrame) -> DataFrame:
    """(session, seq, frames, travel): where a keyframe is due in a session's flow (seq, magnitude): after TRAVEL metres or FRAMES frames since the last."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "magnitude"])
        out, travel, frames = [], 0.0, 0
        for seq, step in zip(rows["seq"].tolist(), (rows["magnitude"].to_numpy(float) * PER_PIXEL).tolist(), strict=True):
            travel, frames = travel + step, frames + 1
            if travel >= TRAVEL or frames >= FRAMES:
                out.append((key[0], seq, frames, travel))
                travel, frames = 0.0, 0
        return pd.DataFrame(out, columns=["session", "seq", "frames", "travel"])

    return deltas_.groupBy("session").applyInPandas(work, f"session {dict(deltas_.dtypes)['session']}, seq long, frames int, travel double")
