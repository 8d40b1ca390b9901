"""The occupancy fold with runs composed before the shuffle.

An update is x -> clamp(x + d) in single precision, which is monotone; so is a
run of them.  A run that takes the least and the greatest value to the same
value takes every value there, and is that value: the updates before it no
longer count.  A few equal updates do, so nearly all runs are two numbers; a run
that doesn't is kept as its steps, a character each, until it meets another.
No rounding is lost: the result is that of adding the updates one by one.

Rows are dealt by ranges of their sequence number (rays before they are carved
into samples), unless the tasks' ranges are apart as they are.  Each task
composes its updates per voxel in NumPy, keyed by Morton key, and yields one row
a voxel.  Runs then meet in a tree of FAN tasks' runs a group, so the largest
group depends on neither the data nor the number of tasks.

Rays that repeat (`carved`) need not all be marched: a settled run makes what
came before it void, so the last rays of each shape, those with the same origin,
direction and length, tell nearly every voxel's value; the shapes through the
others are asked for more rays until none is left out.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import constants as K
from cairn.functions import morton
from cairn.operators import fold
from cairn.sources.shared import checkpointed

#: Updates that a segment holds while it is evaluated, rows a task holds before it composes them, and runs that meet in a group.
SEGMENT, HELD, FAN = 64, 1 << 19, 64
#: Rows that a task carves at most; rays of a shape that are marched first, and how many times as many in each further round; voxels that all tasks hold.
CARVED, FIRST, MORE, SHARED = 1 << 16, 128, 16, 1 << 19
LOW, HIGH, HIT, MISS = (np.float32(v) for v in (K.LOW, K.HIGH, K.HIT, K.MISS))
LAST = ("t_rel", "r", "g", "b", "layer", "class_id")
RUN = "key long, cx short, cy short, cz short, ix short, iy short, iz short, part int, block int, first long, last long, lo float, hi float, steps string, n long, hits long, mask long"


def _folded(start: np.ndarray, hit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Values after each segment's updates; `hit` has a line for each segment, of which `sizes` count."""
    x = start.copy()
    step = np.where(hit, HIT, MISS)
    for k in range(hit.shape[1]):
        more = sizes > k
        x[more] = np.minimum(HIGH, np.maximum(LOW, x[more] + step[more, k]))
    return x


def composed(key: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of updates that lie in order of key, and of time within a key: (starts, lo, hi, steps).

    steps is the text of a run's updates where lo and hi differ, else empty.
    """
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    segments = -(-sizes // SEGMENT)
    first = np.concatenate([[0], np.cumsum(segments)[:-1]]).astype(np.int64) if len(starts) else starts
    run = np.repeat(np.arange(len(starts)), segments)
    at = starts[run] + (np.arange(len(run)) - first[run]) * SEGMENT
    many = np.minimum(SEGMENT, starts[run] + sizes[run] - at)
    wide = at[:, None] + np.arange(min(SEGMENT, int(many.max(initial=0))))
    block = hit[np.minimum(wide, len(hit) - 1)] if len(hit) else np.zeros((0, 0), bool)
    lo, hi = (_folded(np.full(len(run), v), block, many) for v in (LOW, HIGH))
    # from the last segment that settles the value on, the others follow one by one
    settled = np.where(lo == hi, np.arange(len(run)), -1)
    from_ = np.maximum.reduceat(settled, first) if len(starts) else first
    end_lo, end_hi, steps = np.full(len(starts), LOW), np.full(len(starts), HIGH), np.full(len(starts), "", object)
    known = from_ >= 0
    end_lo[known], end_hi[known] = lo[from_[known]], lo[from_[known]]
    tail = np.where(known, from_ + 1, first)
    left = first + segments - tail
    for k in range(int(left.max(initial=0))):
        more = np.flatnonzero(left > k)
        s = tail[more] + k
        end_lo[more], end_hi[more] = _folded(end_lo[more], block[s], many[s]), _folded(end_hi[more], block[s], many[s])
    for i in np.flatnonzero(end_lo != end_hi):
        steps[i] = "".join("+" if h else "-" for h in hit[starts[i] : starts[i] + sizes[i]].tolist())
    return starts, end_lo, end_hi, steps


def _runs(t: pa.Table, part: int, block: int) -> list[pa.RecordBatch]:
    """One row a key of updates (x, y, z, seq, hit, mask and the LAST columns)."""
    key, inside = morton.keys(*(t.column(c).to_numpy() for c in "xyz"))
    if not inside.all():
        t, key = t.filter(pa.array(inside)), key[inside]
    if not len(key):
        return []
    seq = t.column("seq").to_numpy()
    order = np.lexsort((seq, key))
    key, hit = key[order], t.column("hit").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)[order]
    starts, lo, hi, steps = composed(key, hit)
    ends = np.append(starts[1:], len(key)) - 1
    n = ends - starts + 1
    columns = {
        "key": key[starts],
        **morton.corners(key[starts]),
        "part": np.full(len(starts), part, np.int32),
        "block": np.full(len(starts), block, np.int32),
        "first": seq[order[starts]],
        "last": seq[order[ends]],
        "lo": lo,
        "hi": hi,
        "steps": pa.array(steps, pa.string()),
        "n": n,
        "hits": np.add.reduceat(hit.astype(np.int64), starts) if len(starts) else n,
        "mask": np.bitwise_or.reduceat(t.column("mask").to_numpy()[order], starts) if len(starts) else n,
    }
    latest = pa.array(order[ends])
    return pa.table({c: pa.array(columns[c]) for c in ("key", *fold.KEY, "part", "block", "first", "last", "lo", "hi", "steps", "n", "hits", "mask")} | {c: t.column(c).take(latest) for c in t.column_names if c in LAST}).to_batches()


def applied(x: Column, run: Column) -> Column:
    """`x` after a run: its value where it has one, else step by step."""
    f = lambda v: F.lit(v).cast("float")
    stepped = F.aggregate(F.split(run["steps"], ""), x, lambda a, s: F.greatest(f(K.LOW), F.least(f(K.HIGH), a + F.when(s == "+", f(K.HIT)).when(s == "-", f(K.MISS)).otherwise(f(0.0)))))
    return F.when(run["lo"] == run["hi"], run["lo"]).otherwise(stepped)


def _met(rows: DataFrame, last: list[str], part: Column, block: Column) -> DataFrame:
    """Runs of `rows` that share a key, part and block, as one run each."""
    f = lambda v: F.lit(v).cast("float")
    runs = F.array_sort(F.collect_list(F.struct("first", "last", "lo", "hi", "steps")))
    start = F.struct(f(K.LOW).alias("lo"), f(K.HIGH).alias("hi"), F.lit("").alias("steps"), F.lit(-(1 << 63)).cast("long").alias("last"))

    def follow(a: Column, e: Column) -> Column:
        apart = F.when(a["last"] <= e["first"], e["last"]).otherwise(F.raise_error(F.lit("runs of a voxel overlap: sequence numbers aren't dealt by ranges")).cast("long"))
        steps = F.when(e["lo"] == e["hi"], F.lit("")).otherwise(F.concat(a["steps"], e["steps"]))
        return F.struct(applied(a["lo"], e).alias("lo"), applied(a["hi"], e).alias("hi"), steps.alias("steps"), apart.alias("last"))

    whole = F.aggregate(runs, start, follow)
    grouped = rows.groupBy("key", *fold.KEY, part.cast("int").alias("part"), block.cast("int").alias("block")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), whole.alias("f"), F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.bit_or("mask").alias("mask"), *(F.max_by(c, "last").alias(c) for c in last)
    )
    settled = F.when(F.col("f.lo") == F.col("f.hi"), F.lit("")).otherwise(F.col("f.steps"))
    return grouped.select("key", *fold.KEY, "part", "block", "first", "last", F.col("f.lo").alias("lo"), F.col("f.hi").alias("hi"), settled.alias("steps"), "n", "hits", "mask", *last)


def spans(df: DataFrame, seq: str) -> tuple[bool, int, int, int]:
    """Whether the partitions of `df`, as they are, hold ranges of `seq` that don't meet; their number, the rows of the largest, and all.  One pass over that column."""
    each = df.groupBy(F.spark_partition_id().alias("p")).agg(F.min(seq).alias("a"), F.max(seq).alias("z"), F.count(F.lit(1)).alias("n")).collect()  # a row for each task
    ends = sorted((r["a"], r["z"]) for r in each)
    return all(x[1] < y[0] for x, y in zip(ends, ends[1:])), max((r["p"] + 1 for r in each), default=1), max((r["n"] for r in each), default=0), sum(r["n"] for r in each)


def runs(updates: DataFrame) -> tuple[DataFrame, list[str]]:
    """One run a voxel and task of `updates` (x, y, z, seq, hit, and mask and LAST columns where there are any), and its LAST columns."""
    last = [c for c in LAST if c in updates.columns]
    mask = F.col("mask") if "mask" in updates.columns else F.lit(0).cast("long")
    rows = updates.select(*(F.col(a).cast("double").alias(a) for a in "xyz"), F.col("seq").cast("long").alias("seq"), F.col("hit"), mask.alias("mask"), *last)
    kinds = dict(rows.dtypes)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD:
                yield from _runs(pa.Table.from_batches(held), number, block)
                held, n, block = [], 0, block + 1
        if held:
            yield from _runs(pa.Table.from_batches(held), number, block)

    return rows.mapInArrow(part, RUN + "".join(f", {c} {kinds[c]}" for c in last)), last


def voxels(obs: DataFrame, by: str = "seq", carve: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row a voxel of `obs`: cx .. iz, log_odds from zero on, its run (lo, hi, steps), n, hits, mask and LAST columns.

    Rows apply in order of seq; null ones come first.  `carve` turns rows into
    updates with a seq of their own that rises with the column `by`, so that only
    rows are dealt, not updates.  Where tasks' ranges of `by` already lie apart,
    as in a recording, nothing is dealt (but rows to be carved are, to share that work, CARVED or so a task).  Should ranges meet in a retried
    task, that is an error, not a wrong sum.
    """
    obs = obs.withColumn(by, F.coalesce(F.col(by).cast("long"), F.lit(-(1 << 62))))
    lie, parts, most, rows = spans(obs, by)
    lie = lie and not (carve and (parts < obs.sparkSession.sparkContext.defaultParallelism or most > CARVED))  # carving is work to share
    if not lie:
        parts = max(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // CARVED) if carve else 1)
        obs = obs.repartitionByRange(parts, by)
    dealt = obs.sortWithinPartitions(by)
    rows, last = runs(carve(dealt) if carve else dealt)
    if carve or not lie or most >= HELD * FAN:
        rows = checkpointed(rows)
        blocks = rows.agg(F.max("block")).first()[0] or 0
        while blocks >= FAN:
            rows, blocks = checkpointed(_met(rows, last, F.col("part"), F.col("block") / FAN)), blocks // FAN
    while parts > FAN:
        rows, parts = checkpointed(_met(rows, last, F.col("part") / FAN, F.lit(0))), -(-parts // FAN)
    whole = _met(rows, last, F.lit(0), F.lit(0))
    value = applied(F.lit(0.0).cast("float"), F.struct("lo", "hi", "steps"))
    return whole.select("key", *fold.KEY, value.alias("log_odds"), "lo", "hi", "steps", "n", "hits", "mask", *last)


def carved(rays: DataFrame, by: str, carve: Callable[[DataFrame], DataFrame], shape: tuple[str, ...]) -> DataFrame:
    """(cx .. iz, log_odds) of the voxels of `rays` after all of them, from zero on; as `voxels` gives them, to the last bit.

    `carve` yields updates (`by`, x, y, z, seq, hit); rays that agree in `shape` yield
    the same but for seq, which rises with `by`.  A round marches the last rays of each shape.  In a voxel, all
    updates after the last one that was left out are there; if they settle it, or
    none was left out, its value is known.  Shapes through other voxels go into
    the next round with more rays, at last with all.
    """
    at = lambda rows: fold.keyed(carve(rows))
    known, left, n = [], None, FIRST
    while True:
        w = Window.partitionBy(*shape).orderBy(F.desc(by))
        last = checkpointed(rays.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n + 1))  # limited before the shuffle, too
        mine = lambda rows, left=left: rows if left is None else rows.join(F.broadcast(left), fold.KEY, "left_semi")
        out = checkpointed(mine(at(last.where(F.col("_n") == n + 1).drop("_n"))).groupBy(*fold.KEY).agg(F.max("seq").alias("_out")))
        if left is None and out.count() > SHARED:  # too many to hold: every ray is marched
            return voxels(rays, by, carve).select(*fold.KEY, "log_odds")

        def after(part: DataFrame, mine=mine, out=out) -> DataFrame:
            updates = mine(at(part)).join(F.broadcast(out), fold.KEY, "left")  # counted
            return updates.where(F.col("_out").isNull() | (F.col("seq") > F.col("_out")))

        got = checkpointed(voxels(last.where(F.col("_n") <= n).drop("_n"), by, after).select(*fold.KEY, "log_odds", "lo", "hi"))
        whole = got.join(F.broadcast(out), fold.KEY, "left").where(F.col("_out").isNull() | (F.col("lo") == F.col("hi")))
        known.append(whole.select(*fold.KEY, "log_odds"))
        left = checkpointed(out.join(known[-1], fold.KEY, "left_anti").select(*fold.KEY))
        if not left.count():
            return functools.reduce(DataFrame.unionByName, known)
        heads = last.where(F.col("_n") == 1).drop("_n")
        through = at(heads).join(F.broadcast(left), fold.KEY, "left_semi").select(F.col(by).alias("_by")).distinct()
        shapes = checkpointed(heads.join(through.hint("merge"), F.col(by) == F.col("_by"), "left_semi").select(*(F.col(c).alias(f"_{c}") for c in shape)).distinct())
        if shapes.count() <= SHARED:
            rays = rays.join(F.broadcast(shapes), functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in shape)), "left_semi")
        n *= MORE
