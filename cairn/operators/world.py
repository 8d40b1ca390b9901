"""Queries over the voxel table: totals, exports, filters, samples, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import constants as K
from cairn.functions import keys
from cairn.sources.shared import checkpointed

CHUNK = ["cx", "cy", "cz"]
LEAF = ["ix", "iy", "iz"]
ORDER = [*CHUNK, "iz", "iy", "ix"]


def info(voxels: DataFrame) -> DataFrame:
    """Occupied voxels, leaves, chunks and the box of all chunks; zeros for an empty map."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    chunks = voxels.groupBy(*CHUNK).agg(F.count_if(F.col("log_odds") > 0).alias("occupied"), F.count(F.lit(1)).alias("leaves"))
    return chunks.agg(
        zero(F.sum("occupied")).alias("voxel_count"),
        zero(F.sum("leaves")).alias("leaf_count"),
        F.count(F.lit(1)).alias("chunk_count"),
        *(zero(F.min(f"c{a}")).alias(f"min_{a}") for a in "xyz"),
        *(zero(F.max(f"c{a}") + 1).alias(f"max_{a}") for a in "xyz"),
    )


def renderable(log_odds: float = 0.0, observations: int = 0, *, unobserved: bool = False) -> Column:
    """Which leaves a query shows."""
    seen = (F.col("log_odds") >= F.lit(log_odds).cast("float")) & (F.lit(observations == 0) | (F.col("obs_count") >= observations))
    return seen | (F.lit(unobserved) & ((F.col("obs_count") == 0) | (F.col("log_odds") > 0)))


def positioned(voxels: DataFrame, depth: int = K.DEPTH) -> DataFrame:
    """`voxels` with the centres x, y, z of their nodes."""
    return voxels.withColumns({a: keys.centre(F.col(f"c{a}"), F.col(f"i{a}"), depth) for a in "xyz"})


def exported(voxels: DataFrame) -> DataFrame:
    """Leaves of a saved map: centre, packed colour and layer, observations, signed distance (UNKNOWN where none is kept)."""
    at = positioned(voxels.where(renderable()))
    distance = F.col("signed_distance") if "signed_distance" in voxels.columns else F.lit(K.UNKNOWN)
    return at.select("x", "y", "z", keys.pack(F.col("r"), F.col("g"), F.col("b"), F.col("layer"), F.col("class_id")).alias("cf"), "obs_count", F.col("log_odds"), distance.cast("float").alias("signed_distance"))


def probabilities(voxels: DataFrame) -> DataFrame:
    """The properties that follow from a node's fields."""
    return voxels.select(
        *CHUNK,
        *LEAF,
        F.round(1 / (1 + F.exp(-F.col("log_odds").cast("double"))), 6).alias("probability"),
        (F.col("log_odds") > 0).alias("occupied"),
        (F.col("obs_count") == 0).alias("unobserved"),
        ((F.col("obs_count") == 0) | (F.col("log_odds") > 0)).alias("conservatively_occupied"),
        F.bit_count("observer_mask").cast("long").alias("observers"),
    )


def at_depth(voxels: DataFrame, depth: int) -> DataFrame:
    """Nodes at a coarser depth as a live map reads them: interior nodes hold no evidence of their own (zero log-odds, grey)."""
    up = voxels.select(*CHUNK, *(keys.ancestor(F.col(c), depth).alias(c) for c in LEAF)).distinct()
    return up.select(*CHUNK, *LEAF, F.lit(0.0).cast("float").alias("log_odds"), F.lit(0).alias("obs_count"), *(F.lit(K.GREY).cast("long").alias(c) for c in "rgb"))


def summarised(voxels: DataFrame, depth: int) -> DataFrame:
    """Nodes at a coarser depth with what their leaves hold: the most log-odds, all observations, the colour of the likeliest leaf."""
    up = voxels.select(*CHUNK, *(keys.ancestor(F.col(c), depth).alias(c) for c in LEAF), "log_odds", "obs_count", "r", "g", "b", F.struct(F.col("log_odds"), -F.col("iz"), -F.col("iy"), -F.col("ix")).alias("o"))
    return up.groupBy(*CHUNK, *LEAF).agg(F.max("log_odds").alias("log_odds"), F.sum("obs_count").alias("obs_count"), F.count(F.lit(1)).alias("leaves"), *(F.max_by(c, "o").alias(c) for c in "rgb"))


def super_chunks(voxels: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """Super-chunks at two metres a leaf: a hit for each chunk that holds anything; with `dirty` (cx, cy, cz), only those that changed."""
    chunks = voxels.select(*CHUNK).distinct()
    ups = lambda df: df.withColumns({f"s{a}": keys.super_chunk(F.col(f"c{a}")) for a in "xyz"})
    chunks = ups(chunks)
    if dirty is not None:
        chunks = chunks.join(ups(dirty).select("sx", "sy", "sz").distinct(), ["sx", "sy", "sz"], "left_semi")
    leaf = lambda a: F.floor((F.col(f"c{a}") - F.col(f"s{a}") * K.SUPER) / F.lit(2.0)).cast("smallint").alias(f"i{a}")
    up = chunks.select("sx", "sy", "sz", *(leaf(a) for a in "xyz"))
    f = lambda v: F.lit(v).cast("float")
    fused = F.aggregate(F.sequence(F.lit(1), F.col("hits").cast("int")), f(0.0), lambda a, _: F.least(f(K.HIGH), a + f(K.HIT)))
    return up.groupBy("sx", "sy", "sz", *LEAF).agg(F.count(F.lit(1)).alias("hits")).withColumn("log_odds", fused)


def pruned(nodes: DataFrame, depth: int) -> DataFrame:
    """`nodes` (with depth) after nodes at `depth` - 1 took in their children.

    A node does so when all its present children are leaves that agree on
    log-odds over zero or not; it takes its first child's fields.  Rows dealt
    by chunk need no further shuffle.
    """
    up = {f"_p{a}": F.expr(f"cast(shiftright(cast(i{a} as int), greatest(0, depth - {depth - 1})) as smallint)") for a in "xyz"}
    marks = {"_below": F.col("depth") >= depth, "_o": F.col("log_odds") > 0, "_octant": keys.octant(F.col("ix"), F.col("iy"), F.col("iz"))}
    w = Window.partitionBy(*CHUNK, *up, "_below")
    group = {"_same": (F.min("_o").over(w) == F.max("_o").over(w)) & (F.max("depth").over(w) == depth), "_first": F.col("_octant") == F.min("_octant").over(w)}
    taken = F.col("_below") & F.col("_same")
    out = nodes.withColumns(up | marks).withColumns(group).withColumn("_taken", taken).where(~F.col("_taken") | F.col("_first"))
    out = out.withColumns({f"i{a}": F.when(F.col("_taken"), F.col(f"_p{a}")).otherwise(F.col(f"i{a}")) for a in "xyz"})
    out = out.withColumn("depth", F.when(F.col("_taken"), depth - 1).otherwise(F.col("depth")))
    return out.select(*nodes.columns)


def pruned_all(voxels: DataFrame) -> DataFrame:
    """All five levels, leaves first, after one shuffle by chunk."""
    nodes = voxels.withColumn("depth", F.lit(K.DEPTH)).repartition(*CHUNK)
    for depth in range(K.DEPTH, 0, -1):
        nodes = pruned(nodes, depth)
    return nodes


def expired(voxels: DataFrame, now: int | Column, ttl: int = K.TTL) -> DataFrame:
    """`voxels` with the log-odds of dynamic ones that were last seen more than `ttl` before `now` set to zero."""
    old = (F.col("layer") == K.DYNAMIC) & (F.col("last_observed") < F.lit(now) - ttl)
    return voxels.withColumn("log_odds", F.when(old, F.lit(0.0).cast("float")).otherwise(F.col("log_odds")))


def strided(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """Every n-th row in `order`, n = rows div `most`: at most `most` rows, or all where n is under two.

    Rows are numbered without bringing them to one task: each range partition
    counts its own, and a sum of the counts before it is added.
    """
    total = rows.count()
    if total <= most or total // most < 2:
        return rows
    step = total // most
    return numbered(rows, order).where((F.col("rn") % step == 0) & (F.col("rn") < step * most)).drop("rn")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with rn, their place from zero in `order`."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that no two readers coalesce them differently
    # numbered where it lies, as a sorted partition's rows come in order; kept, as the ranges of a second run may differ
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    return ranged.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rn", F.col("before") + within).drop("part", "before", "at")


def sampled_by_chunk(voxels: DataFrame, most: int, depth: int = 2) -> DataFrame:
    """A budget of `most` / chunks nodes of each chunk at a coarse depth, evenly strided."""
    nodes = at_depth(voxels, depth)
    chunks = nodes.select(*CHUNK).distinct().count()
    budget = max(1, most // max(1, chunks))
    w = Window.partitionBy(*CHUNK)
    ranked = nodes.withColumns({"rn": F.row_number().over(w.orderBy("iz", "iy", "ix")) - 1, "n": F.count(F.lit(1)).over(w)})
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / budget))
    kept = ranked.where((F.col("n") <= budget) | ((F.col("rn") % stride == 0) & (F.col("rn") < stride * budget)))
    return positioned(kept.drop("rn", "n"), depth).select(*CHUNK, "x", "y", "z", "r", "g", "b")


def visible(chunks: DataFrame, planes: list[tuple[float, float, float, float]], size: float = 1.0, prefix: str = "c", scale: int = 1) -> DataFrame:
    """Chunks that a frustum may show: for every plane, the corner farthest along its normal is not behind it."""
    out = chunks
    for nx, ny, nz, w in planes:
        far = [F.col(f"{prefix}{a}") * scale + (size if n >= 0 else 0.0) for a, n in zip("xyz", (nx, ny, nz), strict=True)]
        out = out.where(nx * far[0] + ny * far[1] + nz * far[2] + w >= 0)
    return out


def near(voxels: DataFrame, centre: tuple[float, float, float], radius: float) -> DataFrame:
    """Occupied positions within `radius`, inclusive; chunks beyond it are pruned by their keys."""
    import math

    out = voxels
    for a, c in zip("xyz", centre, strict=True):
        out = out.where(F.col(f"c{a}").between(math.floor(c - radius), math.floor(c + radius)))
    at = positioned(out.where(F.col("log_odds") > 0))
    return at.where(sum((F.col(a) - c) ** 2 for a, c in zip("xyz", centre, strict=True)) <= radius * radius)


def intersecting(boxes: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Boxes (min_x .. max_z) that touch the given one, edges included."""
    out = boxes
    for a, lo, hi in zip("xyz", low, high, strict=True):
        out = out.where((F.col(f"min_{a}") <= hi) & (F.col(f"max_{a}") >= lo))
    return out


def box_metrics(boxes: DataFrame) -> DataFrame:
    """`boxes` with size, centre and volume."""
    size = {f"size_{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"}
    mid = {f"mid_{a}": (F.col(f"max_{a}") + F.col(f"min_{a}")) / 2 for a in "xyz"}
    return boxes.withColumns(size | mid).withColumn("volume", F.col("size_x") * F.col("size_y") * F.col("size_z"))


def evicted(accesses: DataFrame, most: int) -> DataFrame:
    """Chunks to spill: all but the `most` that were created last. `accesses`: chunk keys with seq."""
    first = checkpointed(accesses.groupBy(*CHUNK).agg(F.min("seq").alias("created")))
    extra = first.count() - most
    return numbered(first, ["created", *CHUNK]).where(F.col("rn") < extra).drop("rn")


def top_down(points: DataFrame) -> DataFrame:
    """A preview from above: x and z scaled into the unit square, and a hue from the height."""
    box = points.agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    at = points.crossJoin(F.broadcast(box))  # one row
    span = F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_z") - F.col("lo_z"), F.lit(0.001))
    height = F.greatest(F.col("hi_y") - F.col("lo_y"), F.lit(0.001))
    return at.withColumns({"px": (F.col("x") - F.col("lo_x")) / span, "pz": (F.col("z") - F.col("lo_z")) / span, "hue": (F.col("y") - F.col("lo_y")) / height}).drop(*box.columns)


def faces(cuboids: DataFrame) -> DataFrame:
    """Six faces of four corners for each cuboid (mx, my, mz, hx, hy, hz): a row a corner."""
    corners = [(f, k, *_corner(f, k)) for f in range(6) for k in range(4)]
    rows = F.array(*(F.struct(F.lit(f).alias("face"), F.lit(k).alias("corner"), F.lit(x).alias("sx"), F.lit(y).alias("sy"), F.lit(z).alias("sz")) for f, k, x, y, z in corners))
    out = cuboids.withColumn("v", F.explode(rows))
    return out.select(*cuboids.columns, "v.face", "v.corner", *((F.col(f"m{a}") + F.col(f"h{a}") * F.col(f"v.s{a}")).alias(f"v{a}") for a in "xyz"))


def _corner(face: int, k: int) -> tuple[int, int, int]:
    """Signs of a face's k-th corner: the face's own axis fixed, the other two around."""
    axis, sign = face // 2, 1 if face % 2 == 0 else -1
    around = ((-1, -1), (1, -1), (1, 1), (-1, 1))[k]
    out = [0, 0, 0]
    out[axis], out[(axis + 1) % 3], out[(axis + 2) % 3] = sign, *around
    return tuple(out)
