"""Frames as one composed step: depth, rays, carving, detections, solid regions and refinement tasks.

Inference is out of scope: a depth model is a function from pixels to pixels with
a depth d, and detections come as a table.  Everything else is joins and
generators over the frames' rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import camera
from cairn.operators import detect, rays

EXPLORE, REFINE, HYBRID = "explore", "refine", "hybrid"
#: Metres up to which a frame carves, strides of pixels when exploring and refining, and the depth where there is no model.
REACH, STRIDE, FINE_STRIDE, FLAT = 50.0, 4, 2, 2.0
Model = Callable[[DataFrame], DataFrame]


def flat_depth(pixels: DataFrame, depth: float = FLAT) -> DataFrame:
    """`pixels` all at one depth: the fallback without a depth raster."""
    return pixels.withColumn("d", F.lit(float(depth)))


@dataclass
class Pipeline:
    """Depth models and what a frame's processing is set to. mode: explore, refine or hybrid; without a model that a mode needs, frames have no depth."""

    fast: Model | None = None
    fine: Model | None = None
    mode: str = HYBRID
    detection_every: int = 1

    @property
    def ready(self) -> bool:
        """Whether any mode has a model."""
        return self.fast is not None or self.fine is not None

    def depth(self, pixels: DataFrame) -> DataFrame | None:
        """Pixels with depth by the mode's model: the fine one only when refining, and the fast one for want of it."""
        model = (self.fine or self.fast) if self.mode == REFINE else self.fast
        return model(pixels) if model else None

    def process(self, pixels: DataFrame, detections: DataFrame, poses: DataFrame, cam: tuple, *, stride: int = STRIDE, reach: float = REACH) -> dict[str, DataFrame]:
        """`frames` (frame_id, rays, carved, hits), `samples` for the fold, `regions` (solid boxes' chunks) and `tasks` (what to refine first).

        pixels: frame_id, u, v and what the model needs; detections: frame_id,
        det_id, class_id and a box in the world (min_x .. max_z); poses: frame_id
        and a pose, one each.  Detections count in every `detection_every`-th frame,
        where that has depth.
        """
        spark = pixels.sparkSession
        seen = self.depth(pixels)
        lines = world_rays(seen, poses, cam, stride=stride) if seen is not None else None
        if lines is None:
            frames = spark.createDataFrame([], "frame_id long, rays long, carved long, hits long")
            samples = spark.createDataFrame([], "frame_id long, ray_id long, i int, x double, y double, z double, hit boolean")
        else:
            m = rays.marched(lines, most=reach, eye=("ox", "oy", "oz"))
            frames = m.groupBy("frame_id").agg(F.count(F.lit(1)).alias("rays"), F.sum("carved").alias("carved"), F.sum("hits").alias("hits"))
            samples = rays.samples(lines, most=reach, eye=("ox", "oy", "oz"), keep=("frame_id",))
        boxes = detections.where(F.col("frame_id") % max(1, self.detection_every) == 0)
        # a frame without depth ends before its detections
        boxes = boxes.limit(0) if seen is None else boxes.join(seen.select("frame_id").distinct(), "frame_id", "left_semi")
        solid = rays.solid_chunks(boxes).select("frame_id", "det_id", "class_id", "cx", "cy", "cz")
        return {"frames": frames, "samples": samples, "regions": solid, "tasks": detect.region_tasks(boxes)}

    def refined(self, tasks: DataFrame, pixels: DataFrame, poses: DataFrame, cam: tuple) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """The next task, the queue without it, and its frame's samples at a finer stride; None where nothing can be refined."""
        if self.fine is None or self.mode not in (HYBRID, REFINE):
            return None
        head, rest = detect.dequeued(tasks)
        if not head.limit(1).count():
            return None
        lines = world_rays(self.fine(pixels), poses, cam, stride=FINE_STRIDE)
        return head, rest, rays.samples(lines, most=REACH, eye=("ox", "oy", "oz"), keep=("frame_id",))


def world_rays(pixels: DataFrame, poses: DataFrame, cam: tuple, *, stride: int = STRIDE) -> DataFrame:
    """Rays (frame_id, ray_id, ox .. oz, dx .. dz, hit_distance) of strided pixels from their frame's pose. A pixel is one ray of its frame."""
    seen = rays.depth_rays(pixels, cam, stride=stride).join(poses, "frame_id")
    turned = camera.rotate(tuple(F.col(f"q{a}") for a in "xyzw"), tuple(F.col(f"d{a}") for a in "xyz"))
    ray = F.col("v") * cam[4] + F.col("u")
    return seen.select("frame_id", ray.cast("long").alias("ray_id"), *(F.col(f"p{a}").alias(f"o{a}") for a in "xyz"), *(c.alias(f"d{a}") for a, c in zip("xyz", turned, strict=True)), "hit_distance")


def switched(frames: DataFrame, idle: int = detect.IDLE) -> DataFrame:
    """`frames` (session, seq, chunks) with since, the frames since the number of chunks last rose above all before, and idle, whether refinement is due."""
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("seq")
    most = F.coalesce(F.max("chunks").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = frames.withColumn("fresh", F.col("chunks") > most)
    island = F.sum(F.col("fresh").cast("int")).over(w)
    out = marked.withColumn("island", island)
    since = F.count_if(~F.col("fresh")).over(Window.partitionBy("session", "island").orderBy("seq"))
    return out.withColumn("since", since).withColumn("idle", F.col("since") > idle).drop("fresh", "island")
