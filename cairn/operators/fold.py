"""The occupancy fold: observations to voxels.

An update adds a hit's or a miss's log-odds and clamps, so order counts, and
sums won't do.  A run of updates is x -> min(hi, max(lo, x + d)); such
functions compose into one of their kind.  In hundredths this is exact, so
`folded_in_runs` folds runs of BUCKET updates first, then runs of runs: no group
holds more than BUCKET rows of a voxel at once.  `folded` adds in single
precision as a live map does, where a sum of the same updates may differ from
zero by rounding; the module `runs` composes its updates before they cross the
network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import constants as K
from cairn.functions import keys

KEY = ["cx", "cy", "cz", "ix", "iy", "iz"]
BUCKET = 4096


def keyed(obs: DataFrame) -> DataFrame:
    """`obs` with chunk and leaf; points that rounding puts outside their chunk are dropped."""
    for a in keys.AXES:
        obs = obs.withColumn(f"c{a}", keys.chunk(F.col(a)))
    for a in keys.AXES:
        obs = obs.withColumn(f"i{a}", keys.leaf(F.col(a), F.col(f"c{a}")))
    return obs.where(" and ".join(f"i{a} is not null" for a in keys.AXES))


def log_odds(seq: str = "seq", hit: str = "hit") -> Column:
    """The clamped sum of a group's updates in order of `seq`, in single precision."""
    f = lambda v: F.lit(v).cast("float")
    steps = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(hit).alias("h"))))
    return F.aggregate(steps, f(0.0), lambda a, e: F.greatest(f(K.LOW), F.least(f(K.HIGH), a + F.when(e["h"], f(K.HIT)).otherwise(f(K.MISS)))))


def bit(robot: str = "robot") -> Column:
    """The bit of a robot in a mask of observers; those beyond 63 have none."""
    return F.when((F.col(robot) >= 0) & (F.col(robot) < 64), F.expr(f"shiftleft(1L, cast({robot} as int))")).otherwise(F.lit(0).cast("long"))


def folded(obs: DataFrame) -> DataFrame:
    """One row per voxel of `obs` (seq, t_rel, robot, x, y, z, hit, r, g, b, layer, class_id).

    Hits count, up to the most that a node can; colour, layer, class and time
    are the last update's, be it hit or miss; robots up to 63 set their bit.
    Runs of updates are composed where they lie (see `runs`).
    """
    from cairn.operators import runs

    whole = runs.voxels(obs.withColumn("mask", bit()))
    count = F.least(F.lit(K.MOST_OBSERVATIONS), F.col("hits")).cast("int")
    return whole.select(*KEY, "log_odds", count.alias("obs_count"), F.col("mask").alias("observer_mask"), F.col("t_rel").alias("last_observed"), "r", "g", "b", "layer", "class_id")


def _compose(a: Column, b: Column) -> Column:
    """First a, then b."""
    clamp = lambda c: F.least(b["hi"], F.greatest(b["lo"], c + b["d"]))
    return F.struct((a["d"] + b["d"]).alias("d"), clamp(a["lo"]).alias("lo"), clamp(a["hi"]).alias("hi"))


def folded_in_runs(obs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Log-odds per voxel in hundredths, by runs of `bucket` sequence numbers and runs of such runs."""
    low, high = int(K.LOW * 100), int(K.HIGH * 100)
    none = F.struct(F.lit(0).cast("long").alias("d"), F.lit(-(1 << 40)).alias("lo"), F.lit(1 << 40).alias("hi"))
    step = F.struct(F.when(F.col("hit"), round(K.HIT * 100)).otherwise(round(K.MISS * 100)).cast("long").alias("d"), F.lit(low).cast("long").alias("lo"), F.lit(high).cast("long").alias("hi"))

    def level(df: DataFrame, by: Column) -> DataFrame:
        runs = F.array_sort(F.collect_list(F.struct("at", "f")))
        whole = F.aggregate(runs, none, lambda a, e: _compose(a, e["f"]))
        return df.groupBy(*KEY, by.alias("run")).agg(whole.alias("f"), F.sum("n").alias("n"), F.sum("hits").alias("hits")).withColumnRenamed("run", "at")

    run = lambda n: F.floor(F.col("at") / n)
    rows = keyed(obs).select(*KEY, F.col("seq").alias("at"), step.alias("f"), F.lit(1).cast("long").alias("n"), F.col("hit").cast("long").alias("hits"))
    out = level(level(level(rows, run(bucket)), run(bucket)), F.lit(0).cast("long"))
    value = F.greatest(F.col("f.lo"), F.least(F.col("f.hi"), F.lit(0).cast("long") + F.col("f.d")))
    return out.select(*KEY, value.alias("log_odds_100"), "n", "hits")


def merged(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Voxels of `state` after the observations of `batch`, an outer join by voxel: what is new is created, what isn't seen stays."""
    from cairn.operators import runs

    new = runs.voxels(batch).select(*KEY, F.struct("lo", "hi", "steps").alias("run"), "hits", "t_rel", *(F.col(c).alias(f"new_{c}") for c in ("r", "g", "b")))
    start = F.coalesce(F.col("log_odds"), F.lit(0.0).cast("float"))
    return state.join(new, KEY, "full_outer").select(
        *KEY,
        F.when(F.col("run").isNull(), start).otherwise(runs.applied(start, F.col("run"))).alias("log_odds"),
        F.least(F.lit(K.MOST_OBSERVATIONS), F.coalesce("obs_count", F.lit(0)) + F.coalesce("hits", F.lit(0))).cast("int").alias("obs_count"),
        F.coalesce("t_rel", "last_observed").alias("last_observed"),
        *(F.coalesce(f"new_{c}", c).alias(c) for c in ("r", "g", "b")),
    )
