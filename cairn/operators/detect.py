"""Detections: parsing, size priors, projection into the world, and the refinement queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import constants as K
from cairn.operators.rays import solid_chunks
from cairn.sources.shared import checkpointed

CONFIDENT, NEAREST, FARTHEST = 0.5, 5.0, 200.0
QUEUE, THIN, IDLE, EVERY = 500, 3, 300, 10
#: Pixels of a depth raster that all tasks hold; a larger one is joined by shuffling.
RASTER = 1 << 20
# Labels of what is found outdoors.
OUTDOOR = ("car", "truck", "bus", "motorcycle", "bicycle", "person", "dog", "cat", "bench", "fire hydrant", "stop sign", "parking meter", "potted plant", "chair", "dining table")


def priors(spark: SparkSession) -> DataFrame:
    """The size priors, a row for each class."""
    return spark.createDataFrame(K.PRIORS, "class_id long, label string, pw double, ph double, pd double, variance double, prior_layer int")


def with_priors(detections: DataFrame, by: str = "class_id") -> DataFrame:
    """`detections` with the prior of their class or label; nulls where there is none, and class 0 for an unknown label."""
    p = F.broadcast(priors(detections.sparkSession))
    if by == "class_id":
        return detections.join(p, "class_id", "left")
    return detections.join(p, "label", "left").withColumn("class_id", F.coalesce("class_id", F.lit(0).cast("long")))


def blended(detections: DataFrame) -> DataFrame:
    """`detections` (w, h, distance, class_id) with the size bw, bh, bd: the prior's share rises from 5 m to 50 m, to 1 - variance."""
    share = F.greatest(F.lit(0.0), F.least((F.col("distance") - 5.0) / 45.0, F.lit(1.0))) * (1.0 - F.col("variance"))
    out = with_priors(detections).withColumn("share", F.coalesce(share, F.lit(0.0)))
    mix = lambda own, prior: own * (1.0 - F.col("share")) + F.coalesce(F.col(prior), F.lit(0.0)) * F.col("share")
    return out.withColumns({"bw": mix(F.col("w"), "pw"), "bh": mix(F.col("h"), "ph"), "bd": mix(F.least("w", "h"), "pd")})


def parsed(raw: DataFrame) -> DataFrame:
    """Boxes (det_id, cx, cy, w, h, scores array) with corner, best class and confidence; the first of equal scores wins, and only positive ones do."""
    best = F.aggregate(
        F.sequence(F.lit(0), F.size("scores") - 1),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i")),
        lambda a, i: F.when(F.element_at("scores", i + 1).cast("double") > a["s"], F.struct(F.element_at("scores", i + 1).cast("double").alias("s"), i.cast("int").alias("i"))).otherwise(a),
    )
    out = raw.withColumn("best", best).withColumns({"confidence": F.col("best.s"), "class": F.col("best.i"), "x": F.col("cx") - F.col("w") / 2, "y": F.col("cy") - F.col("h") / 2})
    return out.where(F.col("confidence") >= CONFIDENT).withColumn("label", F.concat(F.lit("class_"), F.col("class").cast("string"))).drop("best")


def upper_median(values):
    """The element at half the length of a sorted array; null for none."""
    ordered = F.array_sort(values)
    return F.when(F.size(ordered) > 0, F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int")))


def projected(detections: DataFrame, pixels: DataFrame, cam: tuple, width: int, height: int, at: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Detections (det_id, bx, by, bw, bh in 0..1, class_id) with their median depth and their box in the world.

    The depth raster (u, v, d) is sampled within each box, five a side or so;
    depths outside (0.1, 200) don't count, medians outside [5, 200] go.

    Detections are never sent to all tasks: their table's file says nothing about
    the number of their samples.  The raster is, once its pixels are counted.
    """
    raster = checkpointed(pixels.select("u", "v", "d").where((F.col("d") > 0.1) & (F.col("d") < FARTHEST)))
    raster = F.broadcast(raster) if raster.count() <= RASTER else raster.hint("merge")
    cut = lambda c, n: F.floor(F.col(c) * n).cast("int")
    box = detections.withColumns({"px": cut("bx", width), "py": cut("by", height), "pw": cut("bw", width), "ph": cut("bh", height)})
    box = box.withColumn("step", F.greatest(F.lit(1), F.floor(F.least("pw", "ph") / 5)).cast("int")).where("pw > 0 and ph > 0")
    grid = box.withColumn("dx", F.explode(F.expr("sequence(0, pw - 1, step)"))).withColumn("dy", F.explode(F.expr("sequence(0, ph - 1, step)")))
    hit = grid.withColumns({"u": F.col("px") + F.col("dx"), "v": F.col("py") + F.col("dy")}).join(raster, ["u", "v"])
    med = hit.groupBy("det_id").agg(upper_median(F.collect_list("d")).alias("median")).where(F.col("median").between(NEAREST, FARTHEST))
    out = box.join(med.hint("merge"), "det_id")
    fx, fy, cx, cy = cam[:4]
    m = F.col("median")
    out = out.withColumns({"wx": (F.col("px") + F.col("pw") * 0.5 - cx) / fx * m + at[0], "wy": (F.col("py") + F.col("ph") * 0.5 - cy) / fy * m + at[1], "wz": m + at[2], "w": F.col("pw") / fx * m, "h": F.col("ph") / fy * m, "distance": m})
    out = blended(out.drop("pw", "ph", "bw", "bh"))
    size = {"x": "bw", "y": "bh", "z": "bd"}
    return out.withColumns({f"{e}_{a}": F.col(f"w{a}") + (F.col(s) * (0.5 if e == "max" else -0.5)) for a, s in size.items() for e in ("min", "max")})


def thin_chunks(voxels: DataFrame, queued: DataFrame | None = None, *, thin: int = THIN) -> DataFrame:
    """(cx, cy, cz, voxels) of chunks with fewer occupied voxels than `thin` but not none, that aren't `queued`."""
    out = voxels.groupBy("cx", "cy", "cz").agg(F.count_if(F.col("log_odds") > 0).alias("voxels")).where(F.col("voxels").between(1, thin - 1))
    return out if queued is None else out.join(queued.select("cx", "cy", "cz"), ["cx", "cy", "cz"], "left_anti")


def queue(tasks: DataFrame, most: int = QUEUE) -> DataFrame:
    """The queue after `tasks` (seq, cx, cy, cz, priority, observations) came in: the first of a key, the first `most` keys; `place` orders them.

    Late arrivals lose to a full queue, urgent or not.
    """
    key = ["cx", "cy", "cz"]
    first = tasks.groupBy(*key).agg(F.min("seq").alias("seq"), F.min_by(F.struct("priority", "observations"), "seq").alias("t")).orderBy("seq").limit(most)
    rows = first.select(*key, "t.priority", "t.observations", "seq")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("priority", "observations", "seq")))  # `most` rows at most


def dequeued(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The task that is first in a queue (a row at most), and the queue without it; both keep `place`."""
    first = tasks.agg(F.min("place").alias("place"))
    return tasks.join(F.broadcast(first), "place", "left_semi"), tasks.join(F.broadcast(first), "place", "left_anti")  # one row


def pruned_queue(tasks: DataFrame, chunks: DataFrame) -> DataFrame:
    """The queue without tasks for chunks that no longer exist."""
    return tasks.join(chunks.select("cx", "cy", "cz").distinct(), ["cx", "cy", "cz"], "left_semi")


def region_tasks(boxes: DataFrame, priority: int = 1) -> DataFrame:
    """Refinement tasks for every chunk of the boxes."""
    return solid_chunks(boxes).select("cx", "cy", "cz", F.lit(priority).alias("priority"), F.lit(0.0).alias("observations")).distinct()


def idle_runs(frames: DataFrame, least: int = IDLE) -> DataFrame:
    """(session, island, frames) of runs of more than `least` frames without a new chunk. `frames`: session, seq, fresh."""
    w = Window.partitionBy("session").orderBy("seq")
    marked = frames.withColumn("island", F.sum(F.col("fresh").cast("int")).over(w))
    return marked.where(~F.col("fresh")).groupBy("session", "island").agg(F.count(F.lit(1)).alias("frames")).where(F.col("frames") > least)
