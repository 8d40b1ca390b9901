"""Row generators: rays to samples, boxes to chunks, rasters to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import camera, keys

#: Steps of carving by the distance of a ray's middle, and samples of a ray at most, near and far.
STEPS = ((10.0, 1 / 32), (30.0, 1 / 16), (80.0, 1 / 8))
FAR_STEP, MOST_NEAR, MOST_FAR = 1 / 2, 512, 256


def _length(*c: Column) -> Column:
    return F.sqrt(sum(x * x for x in c))


def marched(rays: DataFrame, camera_at: tuple[float, float, float] = (0.0, 0.0, 0.0), most: float = 10.0, *, eye: tuple[str, str, str] | None = None) -> DataFrame:
    """`rays` (ox .. dz, hit_distance) with step, steps, stride and end of their carving; rays of no length go.

    `eye` names the columns of each ray's camera where it isn't `camera_at` for all.
    """
    reach = F.coalesce(F.col("hit_distance"), F.lit(most))
    at = [F.col(c) for c in eye] if eye else [F.lit(c) for c in camera_at]
    mid = _length(*(F.col(f"o{a}") + F.col(f"d{a}") * reach / 2 - c for a, c in zip("xyz", at, strict=True)))
    step = F
    for far, size in STEPS:
        step = step.when(mid < far, size)
    out = rays.where(reach > 0).withColumns({"mid": mid, "step": step.otherwise(FAR_STEP)})
    out = out.withColumn("end", F.when(F.col("hit_distance").isNotNull(), F.greatest(F.lit(0.0), F.col("hit_distance") - 2 * F.col("step"))).otherwise(F.lit(most)))
    out = out.withColumn("steps", F.floor(F.col("end") / F.col("step")).cast("int"))
    limit = F.least(F.col("steps"), F.when(F.col("mid") < STEPS[0][0], MOST_NEAR).otherwise(MOST_FAR))
    out = out.withColumn("stride", F.when(limit > 0, F.greatest(F.lit(1), F.floor(F.col("steps") / limit))).otherwise(1).cast("int"))
    carved = F.when(F.col("steps") >= 1, F.floor((F.col("steps") - 1) / F.col("stride")) + 1).otherwise(0)
    return out.withColumns({"carved": carved.cast("long"), "hits": (F.col("hit_distance") <= most).cast("long")}).withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def samples(rays: DataFrame, camera_at: tuple[float, float, float] = (0.0, 0.0, 0.0), most: float = 10.0, *, eye: tuple[str, str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(`keep`, ray_id, i, x, y, z, hit): the misses along each ray in order, then its hit."""
    m = marched(rays, camera_at, most, eye=eye)
    last = F.lit((1 << 31) - 1)
    misses = F.expr("if(steps >= 1, sequence(1, steps, stride), array())").cast("array<int>")
    each = m.withColumn("i", F.explode(F.concat(misses, F.when(F.col("hits") == 1, F.array(last)).otherwise(F.array().cast("array<int>")))))
    hit = F.col("i") == last
    out = each.withColumns({"hit": hit, "t": F.when(hit, F.col("hit_distance")).otherwise(F.col("i") * F.col("step"))})
    return out.select(*keep, "ray_id", "i", *((F.col(f"o{a}") + F.col(f"d{a}") * F.col("t")).alias(a) for a in "xyz"), "hit")


def scan_samples(lidar: DataFrame, most: int = 25) -> DataFrame:
    """Per point of a scan: its hit (s = 0), then misses one resolution apart from the sensor, short of the point."""
    d = [F.col(a) - F.col(f"o{a}") for a in "xyz"]
    out = lidar.withColumn("dist", _length(*d))
    n = F.least(F.floor(F.col("dist") / F.col("res")).cast("int") - 1, F.lit(most))
    out = out.withColumn("s", F.explode(F.when(n >= 1, F.sequence(F.lit(0), n)).otherwise(F.array(F.lit(0)))))
    t = F.when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s") * F.col("res") / F.col("dist"))
    return out.select("frame_id", "pt_idx", "s", *((F.col(f"o{a}") + (F.col(a) - F.col(f"o{a}")) * t).alias(a) for a in "xyz"), (F.col("s") == 0).alias("hit"))


def carved_points(points: DataFrame, eye: tuple[float, float, float], start: float = 0.3, step: float = 0.05, margin: float = 0.05, most: int = 50) -> DataFrame:
    """`points` with dist from the eye and k, the free samples before each: from `start` to `margin` short of it, `most` at most."""
    dist = _length(*(F.col(a) - c for a, c in zip("xyz", eye, strict=True)))
    out = points.withColumn("dist", dist)
    k = F.when(F.col("dist") - margin > start, F.least(F.floor((F.col("dist") - margin - start) / step).cast("int"), F.lit(most))).otherwise(0)
    return out.withColumn("k", k)


def carve_samples(points: DataFrame, eye: tuple[float, float, float], start: float = 0.3, step: float = 0.05, **more) -> DataFrame:
    """(columns of `points`, s, x, y, z, hit, depth): each coloured point's hit (s = 0), then its free samples from the eye on.

    depth is what the sample's chunk is shown at, which a subtractive update goes
    down to.
    """
    out = carved_points(points, eye, start, step, **more).withColumn("s", F.explode(F.expr("if(k >= 1, sequence(0, k), array(0))")))
    along = (F.lit(start) + (F.col("s") - 1) * step) / F.col("dist")
    moved = {a: F.when(F.col("s") == 0, F.col(a)).otherwise(c + (F.col(a) - c) * along) for a, c in zip("xyz", eye, strict=True)}
    out = out.withColumns(moved).withColumn("hit", F.col("s") == 0)
    corner = _length(*(F.floor(F.col(a)) + 0.5 - c for a, c in zip("xyz", eye, strict=True)))
    return out.withColumn("depth", keys.lod(corner)).drop("dist", "k")


def solid_chunks(boxes: DataFrame) -> DataFrame:
    """`boxes` (min_x .. max_z) repeated for each chunk key from the least to the greatest corner, both included."""
    out = boxes
    for a in "xyz":
        span = F.sequence(keys.chunk(F.col(f"min_{a}")).cast("int"), keys.chunk(F.col(f"max_{a}")).cast("int"))
        out = out.withColumn(f"c{a}", F.explode(span.cast("array<smallint>")))
    return out


def depth_points(pixels: DataFrame, cam: tuple, *, stride: int = 1, nearest: float = 0.1, farthest: float = 100.0) -> DataFrame:
    """Camera points of every `stride`-th pixel with a depth (along the axis) between the bounds, both included."""
    seen = pixels.where((F.col("u") % stride == 0) & (F.col("v") % stride == 0) & F.col("d").between(nearest, farthest))
    x, y, z = camera.unproject(F.col("u"), F.col("v"), F.col("d"), cam)
    return seen.withColumns({"x": x, "y": y, "z": z})


def depth_rays(pixels: DataFrame, cam: tuple, *, stride: int = 4) -> DataFrame:
    """Unit directions of strided pixels, with the depth as the ray's length; depths between 0.1 and 100, both left out."""
    fx, fy, cx, cy = cam[:4]
    seen = pixels.where((F.col("u") % stride == 0) & (F.col("v") % stride == 0) & (F.col("d") > 0.1) & (F.col("d") < 100))
    x, y = (F.col("u") - cx) / fx, (F.col("v") - cy) / fy
    n = _length(x, y, F.lit(1.0))
    return seen.withColumns({"dx": x / n, "dy": y / n, "dz": 1 / n, "hit_distance": F.col("d")})


def coloured(points: DataFrame, pixels: DataFrame, cam: tuple, pose: tuple, nearest: float = 0.05) -> DataFrame:
    """`points` (x, y, z) with the colour of the pixel that shows them; points behind or outside the image go. `pixels`: u, v, r, g, b, one each."""
    t, q = pose[:3], pose[3:]
    cam_point = camera.inverse_transform(tuple(map(F.lit, q)), tuple(map(F.lit, t)), (F.col("x"), F.col("y"), F.col("z")))
    u, v = camera.project(*cam_point, cam)
    seen = points.withColumns({"depth": cam_point[2], "u": F.floor(u).cast("long"), "v": F.floor(v).cast("long")}).where((F.col("depth") > nearest) & F.col("u").isNotNull())
    return seen.join(pixels.select("u", "v", "r", "g", "b"), ["u", "v"])


# --- flow rasters -----------------------------------------------------------


def flow_means(flow: DataFrame, step: int = 4, most: float = 100.0) -> DataFrame:
    """(frame_id, dx, dy, magnitude): means over every `step`-th pixel whose vector is shorter than `most`; zeros without any."""
    grid = (F.col("u") % step == 0) & (F.col("v") % step == 0) & (_length(F.col("fx"), F.col("fy")) < most)
    mean = lambda c: F.coalesce(F.avg(F.when(grid, c)), F.lit(0.0))
    return flow.groupBy("frame_id").agg(mean(F.col("fx")).alias("dx"), mean(F.col("fy")).alias("dy"), mean(_length(F.col("fx"), F.col("fy"))).alias("magnitude"))


def parallax(flow: DataFrame, focal: float, scale: float = 1.0, step: int = 4, least: float = 0.15, nearest: float = 0.3, farthest: float = 8.0) -> DataFrame:
    """Depth from the flow that the frame's mean doesn't explain: focal x scale x 20 over its length, within bounds."""
    means = flow_means(flow, step)
    grid = flow.where((F.col("u") % step == 0) & (F.col("v") % step == 0) & (_length(F.col("fx"), F.col("fy")) < 100))
    at = grid.join(means, "frame_id").withColumn("parallax", _length(F.col("fx") - F.col("dx"), F.col("fy") - F.col("dy"))).where(F.col("parallax") >= least)
    depth = F.greatest(F.lit(nearest), F.least(F.lit(farthest), F.lit(focal * scale * 20) / F.col("parallax")))
    return at.select("frame_id", "u", "v", "fx", "fy", "parallax", depth.alias("depth"))


def correspondences(flow: DataFrame, cam: tuple, width: int, height: int, most: int = 300, least: float = 0.2) -> DataFrame:
    """(frame_id, u, v, x1, y1, x2, y2): normalised point pairs of a strided flow raster of width x height."""
    fx, fy, cx, cy, w, h = cam[:6]
    step = max(1, int((width * height // most) ** 0.5))
    sx, sy = w / width, h / height
    mag = _length(F.col("fx"), F.col("fy"))
    grid = flow.where((F.col("u") % step == step // 2) & (F.col("v") % step == step // 2) & (mag >= least) & (mag < 100))
    u2, v2 = F.col("u") * sx + sx * 0.5, F.col("v") * sy + sy * 0.5
    at = grid.withColumns({"u2": u2, "v2": v2, "u1": u2 + F.col("fx") * sx, "v1": v2 + F.col("fy") * sy})
    at = at.where(F.col("u1").between(0, w) & (F.col("u1") < w) & F.col("v1").between(0, h) & (F.col("v1") < h))
    return at.select("frame_id", "u", "v", ((F.col("u1") - cx) / fx).alias("x1"), ((F.col("v1") - cy) / fy).alias("y1"), ((F.col("u2") - cx) / fx).alias("x2"), ((F.col("v2") - cy) / fy).alias("y2"))


def lod_depth(points: DataFrame, eye: tuple[float, float, float]) -> DataFrame:
    """Chunks (cx, cy, cz) with the distance of their centre from the eye, the depth that they are shown at, and the voxel size."""
    d = _length(*(F.col(f"c{a}") + 0.5 - c for a, c in zip("xyz", eye, strict=True)))
    out = points.withColumn("distance", d)
    return out.withColumn("depth", keys.lod(F.col("distance"))).withColumn("size", F.lit(1.0) / F.pow(F.lit(2.0), F.col("depth")))
