"""Registered queries: an operator over a derived view, and the SQL that checks it.

`register` ties the two together; SQL is None where the operator is iterative,
depends on scan order or keeps state across a stream.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import constants as K
from cairn.functions import camera, colour, keys, text
from cairn.operators import detect, fold, grouped, rays, runs, sequence, spatial, world
from cairn.views import table, view, view_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EYE = (2.0, 3.0, 0.5)
PLANES = [(1.0, 0.0, 0.0, -0.5), (0.0, -1.0, 0.0, 6.0), (0.7, 0.7, 0.0, -1.0)]
CAM = (8.0, 8.0, 8.0, 6.0, 16, 12, 0.0, 0.0, 0.0, 0.0, 0.0)

_KEYED = """obs AS ({obs}), keyed AS (
  SELECT *, CAST(floor(x) AS SMALLINT) AS cx, CAST(floor(y) AS SMALLINT) AS cy, CAST(floor(z) AS SMALLINT) AS cz,
         CAST(floor((x - floor(x)) * 32) AS SMALLINT) AS ix, CAST(floor((y - floor(y)) * 32) AS SMALLINT) AS iy, CAST(floor((z - floor(z)) * 32) AS SMALLINT) AS iz
  FROM obs)"""
_FOLDED = """, folded AS (
  SELECT cx, cy, cz, ix, iy, iz,
         list_reduce(list_prepend(0::FLOAT, list(CASE WHEN hit THEN 0.85::FLOAT ELSE -0.7::FLOAT END ORDER BY seq)),
                     lambda a, e: greatest(-2::FLOAT, least(3.5::FLOAT, a + e))) AS log_odds,
         CAST(least(65535, sum(CASE WHEN hit THEN 1 ELSE 0 END)) AS INTEGER) AS obs_count,
         bit_or(CASE WHEN robot = 63 THEN -9223372036854775808 ELSE (1::BIGINT << CAST(robot AS INTEGER)) END) AS observer_mask,
         arg_max(t_rel, seq) AS last_observed, arg_max(r, seq) AS r, arg_max(g, seq) AS g, arg_max(b, seq) AS b,
         arg_max(layer, seq) AS layer, arg_max(class_id, seq) AS class_id
  FROM keyed GROUP BY cx, cy, cz, ix, iy, iz)"""
FOLD = "WITH " + _KEYED.format(obs=view_sql("obs")) + _FOLDED + " "


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.folded(view(spark, sf_dir, "obs"))


def _long(*columns: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in columns]


# --- the map ----------------------------------------------------------------


@register(
    "map_info",
    FOLD
    + """SELECT count(*) FILTER (log_odds > 0) AS voxel_count, count(*) AS leaf_count, count(DISTINCT (cx, cy, cz)) AS chunk_count,
         CAST(min(cx) AS BIGINT) AS min_x, CAST(min(cy) AS BIGINT) AS min_y, CAST(min(cz) AS BIGINT) AS min_z,
         CAST(max(cx) + 1 AS BIGINT) AS max_x, CAST(max(cy) + 1 AS BIGINT) AS max_y, CAST(max(cz) + 1 AS BIGINT) AS max_z FROM folded""",
)
def map_info(spark, sf_dir):
    return world.info(voxels(spark, sf_dir))


@register("voxel_fold", FOLD + "SELECT * FROM folded")
def voxel_fold(spark, sf_dir):
    return voxels(spark, sf_dir).withColumns({c: F.col(c).cast("int") for c in ("layer",)})


@register(
    "voxel_fold_in_runs",
    "WITH "
    + _KEYED.format(obs=view_sql("obs"))
    + """SELECT cx, cy, cz, ix, iy, iz,
         list_reduce(list_prepend(0::BIGINT, list(CASE WHEN hit THEN 85::BIGINT ELSE -70::BIGINT END ORDER BY seq)), lambda a, e: greatest(-200, least(350, a + e))) AS log_odds_100,
         count(*) AS n, count(*) FILTER (hit) AS hits FROM keyed GROUP BY cx, cy, cz, ix, iy, iz""",
)
def voxel_fold_in_runs(spark, sf_dir):
    return fold.folded_in_runs(view(spark, sf_dir, "obs"), bucket=16)


@register("merge_batch", FOLD + "SELECT cx, cy, cz, ix, iy, iz, log_odds, obs_count, last_observed, r, g, b FROM folded")
def merge_batch(spark, sf_dir):
    """A state of the first half and a batch of the second give the fold of both."""
    obs = view(spark, sf_dir, "obs")
    half = obs.agg((F.max("seq") / 2).cast("long")).first()[0] or 0
    state = fold.folded(obs.where(F.col("seq") < half)).select(*fold.KEY, "log_odds", "obs_count", "last_observed", "r", "g", "b")
    return fold.merged(state, obs.where(F.col("seq") >= half))


_CENTRES = "cx + (ix + 0.5e0) / 32e0 AS x, cy + (iy + 0.5e0) / 32e0 AS y, cz + (iz + 0.5e0) / 32e0 AS z"
_CF = "CAST(r * 16777216 + g * 65536 + b * 256 + layer * 64 + class_id AS BIGINT)"


@register("voxel_leaf_export", FOLD + f"SELECT {_CENTRES}, {_CF} AS cf, obs_count, log_odds, 3.4028234663852886e38::FLOAT AS signed_distance FROM folded WHERE log_odds >= 0")
def voxel_leaf_export(spark, sf_dir):
    return world.exported(voxels(spark, sf_dir))


@register("occupied_positions", FOLD + f"SELECT {_CENTRES} FROM folded WHERE log_odds >= 0.4::FLOAT")
def occupied_positions(spark, sf_dir):
    return world.positioned(voxels(spark, sf_dir).where(world.renderable(0.4))).select("x", "y", "z")


@register("render_filter", FOLD + "SELECT cx, cy, cz, ix, iy, iz FROM folded WHERE (log_odds >= 0.4::FLOAT AND obs_count >= 2) OR obs_count = 0 OR log_odds > 0")
def render_filter(spark, sf_dir):
    return voxels(spark, sf_dir).where(world.renderable(0.4, 2, unobserved=True)).select(*fold.KEY)


@register(
    "node_properties",
    FOLD
    + """SELECT cx, cy, cz, ix, iy, iz, round(1 / (1 + exp(-CAST(log_odds AS DOUBLE))), 6) AS probability, log_odds > 0 AS occupied, obs_count = 0 AS unobserved,
         obs_count = 0 OR log_odds > 0 AS conservatively_occupied, CAST(bit_count(observer_mask) AS BIGINT) AS observers FROM folded""",
)
def node_properties(spark, sf_dir):
    return world.probabilities(voxels(spark, sf_dir))


def _lod(depth: int) -> None:
    shift = K.DEPTH - depth
    up = ", ".join(f"CAST(i{a} >> {shift} AS SMALLINT) AS i{a}" for a in "xyz")

    @register(f"lod_rollup_d{depth}", FOLD + f"SELECT DISTINCT cx, cy, cz, {up}, 0::FLOAT AS log_odds, 0 AS obs_count, 128::BIGINT AS r, 128::BIGINT AS g, 128::BIGINT AS b FROM folded")
    def as_read(spark, sf_dir):
        return world.at_depth(voxels(spark, sf_dir), depth)

    @register(
        f"lod_summary_d{depth}",
        FOLD
        + f""", up AS (SELECT cx, cy, cz, {up}, log_odds, obs_count, r, g, b, -((iz * 32 + iy) * 32 + ix) AS o FROM folded)
        SELECT cx, cy, cz, ix, iy, iz, max(log_odds) AS log_odds, CAST(sum(obs_count) AS BIGINT) AS obs_count, count(*) AS leaves,
        arg_max(r, (log_odds, o)) AS r, arg_max(g, (log_odds, o)) AS g, arg_max(b, (log_odds, o)) AS b FROM up GROUP BY cx, cy, cz, ix, iy, iz""",
    )
    def summed(spark, sf_dir):
        return world.summarised(voxels(spark, sf_dir), depth)


for _depth in (4, 3, 1):
    _lod(_depth)


@register(
    "superchunk_rollup",
    FOLD
    + """, chunks AS (SELECT DISTINCT cx, cy, cz FROM folded), up AS (SELECT CAST(floor(cx / 16.0) AS SMALLINT) AS sx, CAST(floor(cy / 16.0) AS SMALLINT) AS sy, CAST(floor(cz / 16.0) AS SMALLINT) AS sz, cx, cy, cz FROM chunks),
    leaf AS (SELECT sx, sy, sz, CAST(floor((cx - sx * 16) / 2.0) AS SMALLINT) AS ix, CAST(floor((cy - sy * 16) / 2.0) AS SMALLINT) AS iy, CAST(floor((cz - sz * 16) / 2.0) AS SMALLINT) AS iz FROM up)
    SELECT sx, sy, sz, ix, iy, iz, count(*) AS hits, list_reduce(list_prepend(0::FLOAT, list(0.85::FLOAT)), lambda a, e: least(3.5::FLOAT, a + e)) AS log_odds FROM leaf GROUP BY sx, sy, sz, ix, iy, iz""",
)
def superchunk_rollup(spark, sf_dir):
    return world.super_chunks(voxels(spark, sf_dir))


@register("superchunk_dirty", FOLD + "SELECT CAST(count(*) AS BIGINT) AS leaves, CAST(sum(n) AS BIGINT) AS chunks FROM (SELECT count(*) AS n FROM (SELECT DISTINCT cx, cy, cz FROM folded WHERE floor(cy / 16.0) IN (SELECT floor(cy / 16.0) FROM folded WHERE cy = 0)) GROUP BY floor(cx / 2.0), floor(cy / 2.0), floor(cz / 2.0))")
def superchunk_dirty(spark, sf_dir):
    v = voxels(spark, sf_dir)
    out = world.super_chunks(v, dirty=v.where("cy = 0"))
    return out.agg(F.count(F.lit(1)).alias("leaves"), F.sum("hits").alias("chunks"))


@register(
    "prune_level",
    FOLD
    + """, g AS (SELECT cx, cy, cz, ix >> 1 AS px, iy >> 1 AS py, iz >> 1 AS pz, bool_and(log_odds > 0) OR NOT bool_or(log_odds > 0) AS same,
         arg_min(log_odds, (ix % 2) + 2 * (iy % 2) + 4 * (iz % 2)) AS log_odds, arg_min(obs_count, (ix % 2) + 2 * (iy % 2) + 4 * (iz % 2)) AS obs_count FROM folded GROUP BY 1, 2, 3, 4, 5, 6)
    SELECT cx, cy, cz, CAST(px AS SMALLINT) AS ix, CAST(py AS SMALLINT) AS iy, CAST(pz AS SMALLINT) AS iz, 4 AS depth, log_odds, obs_count FROM g WHERE same
    UNION ALL SELECT f.cx, f.cy, f.cz, f.ix, f.iy, f.iz, 5, f.log_odds, f.obs_count FROM folded f JOIN g ON f.cx = g.cx AND f.cy = g.cy AND f.cz = g.cz AND f.ix >> 1 = g.px AND f.iy >> 1 = g.py AND f.iz >> 1 = g.pz WHERE NOT same""",
)
def prune_level(spark, sf_dir):
    nodes = voxels(spark, sf_dir).select(*fold.KEY, F.lit(K.DEPTH).alias("depth"), "log_odds", "obs_count")
    return world.pruned(nodes, K.DEPTH)


def _pruned_sql() -> str:
    out = ", n5 AS (SELECT cx, cy, cz, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(iz AS INTEGER) AS iz, 5 AS depth, log_odds, obs_count FROM folded)"
    for d in range(5, 0, -1):
        up = ", ".join(f"i{a} >> greatest(0, depth - {d - 1}) AS p{a}" for a in "xyz")
        octant = "(ix % 2) + 2 * (iy % 2) + 4 * (iz % 2)"
        out += f""", g{d} AS (SELECT *, {up}, depth >= {d} AS below FROM n{d}),
        m{d} AS (SELECT cx, cy, cz, px, py, pz, max(depth) = {d} AND (bool_and(log_odds > 0) OR NOT bool_or(log_odds > 0)) AS same, arg_min(log_odds, {octant}) AS l, arg_min(obs_count, {octant}) AS o FROM g{d} WHERE below GROUP BY ALL),
        n{d - 1} AS (SELECT cx, cy, cz, px AS ix, py AS iy, pz AS iz, {d - 1} AS depth, l AS log_odds, o AS obs_count FROM m{d} WHERE same
          UNION ALL SELECT g.cx, g.cy, g.cz, g.ix, g.iy, g.iz, g.depth, g.log_odds, g.obs_count FROM g{d} g LEFT JOIN m{d} m ON g.below AND g.cx = m.cx AND g.cy = m.cy AND g.cz = m.cz AND g.px = m.px AND g.py = m.py AND g.pz = m.pz WHERE NOT g.below OR NOT m.same)"""
    return out + " SELECT cx, cy, cz, CAST(ix AS SMALLINT) AS ix, CAST(iy AS SMALLINT) AS iy, CAST(iz AS SMALLINT) AS iz, depth, log_odds, obs_count FROM n0"


@register("prune_all", FOLD + _pruned_sql())
def prune_all(spark, sf_dir):
    return world.pruned_all(voxels(spark, sf_dir).select(*fold.KEY, "log_odds", "obs_count"))


@register("expire_dynamic", FOLD + "SELECT cx, cy, cz, ix, iy, iz, CASE WHEN layer = 2 AND last_observed < 9000 - 30 THEN 0::FLOAT ELSE log_odds END AS log_odds FROM folded")
def expire_dynamic(spark, sf_dir):
    return world.expired(voxels(spark, sf_dir), 9000).select(*fold.KEY, "log_odds")


@register("dirty_chunks", "WITH " + _KEYED.format(obs=view_sql("obs")) + "SELECT DISTINCT cx, cy, cz FROM keyed WHERE seq >= 5000")
def dirty_chunks(spark, sf_dir):
    return fold.keyed(view(spark, sf_dir, "obs").where("seq >= 5000")).select("cx", "cy", "cz").distinct()


@register("remove_chunk", FOLD + "SELECT cx, cy, cz, ix, iy, iz FROM folded WHERE NOT (cx = 1 AND cy = 2)")
def remove_chunk(spark, sf_dir):
    v = voxels(spark, sf_dir)
    gone = v.where("cx = 1 and cy = 2").select("cx", "cy", "cz").distinct()
    return v.join(gone, ["cx", "cy", "cz"], "left_anti").select(*fold.KEY)


@register(
    "evict",
    "WITH " + _KEYED.format(obs=view_sql("obs")) + ", c AS (SELECT cx, cy, cz, min(seq) AS created FROM keyed GROUP BY cx, cy, cz) SELECT cx, cy, cz, created FROM c ORDER BY created, cx, cy, cz LIMIT (SELECT greatest(0, count(*) - 5) FROM c)",
)
def evict(spark, sf_dir):
    return world.evicted(fold.keyed(view(spark, sf_dir, "obs")), 5)


@register(
    "sample_stride",
    FOLD
    + f""", p AS (SELECT {_CENTRES}, row_number() OVER (ORDER BY cx, cy, cz, iz, iy, ix) - 1 AS rn, count(*) OVER () AS n FROM folded WHERE log_odds >= 0)
    SELECT x, y, z FROM p WHERE n <= 100 OR n // 100 < 2 OR (rn % (n // 100) = 0 AND rn < (n // 100) * 100)""",
)
def sample_stride(spark, sf_dir):
    rows = voxels(spark, sf_dir).where(world.renderable()).select(*fold.KEY)
    return world.positioned(world.strided(rows, 100, world.ORDER)).select("x", "y", "z")


@register(
    "sample_by_chunk",
    FOLD
    + """, up AS (SELECT DISTINCT cx, cy, cz, ix >> 3 AS ix, iy >> 3 AS iy, iz >> 3 AS iz FROM folded),
    k AS (SELECT greatest(1, 64 // count(DISTINCT (cx, cy, cz))) AS budget FROM up),
    n AS (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY iz, iy, ix) - 1 AS rn, count(*) OVER (PARTITION BY cx, cy, cz) AS n FROM up)
    SELECT cx, cy, cz, cx + (ix + 0.5e0) / 4e0 AS x, cy + (iy + 0.5e0) / 4e0 AS y, cz + (iz + 0.5e0) / 4e0 AS z, 128::BIGINT AS r, 128::BIGINT AS g, 128::BIGINT AS b
    FROM n, k WHERE n <= budget OR (rn % greatest(1, n // budget) = 0 AND rn < greatest(1, n // budget) * budget)""",
)
def sample_by_chunk(spark, sf_dir):
    return world.sampled_by_chunk(voxels(spark, sf_dir), 64)


_VISIBLE = " AND ".join(f"{nx} * (cx + {int(nx >= 0)}) + {ny} * (cy + {int(ny >= 0)}) + {nz} * (cz + {int(nz >= 0)}) + {w} >= 0" for nx, ny, nz, w in PLANES)


@register("frustum_cull", FOLD + f"SELECT DISTINCT cx, cy, cz FROM folded WHERE {_VISIBLE}")
def frustum_cull(spark, sf_dir):
    return world.visible(voxels(spark, sf_dir).select("cx", "cy", "cz").distinct(), PLANES)


@register("frustum_voxels", FOLD + f"SELECT {_CENTRES} FROM folded WHERE {_VISIBLE} AND log_odds >= 0")
def frustum_voxels(spark, sf_dir):
    v = voxels(spark, sf_dir)
    seen = world.visible(v.select("cx", "cy", "cz").distinct(), PLANES)
    return world.positioned(v.where(world.renderable()).join(seen, ["cx", "cy", "cz"], "left_semi")).select("x", "y", "z")


@register(
    "superchunk_band",
    FOLD
    + """, s AS (SELECT DISTINCT CAST(floor(cx / 16.0) AS SMALLINT) AS sx, CAST(floor(cy / 16.0) AS SMALLINT) AS sy, CAST(floor(cz / 16.0) AS SMALLINT) AS sz FROM folded)
    SELECT sx, sy, sz, sqrt((sx * 16 + 8e0 + 100) * (sx * 16 + 8e0 + 100) + (sy * 16 + 8e0) * (sy * 16 + 8e0) + (sz * 16 + 8e0) * (sz * 16 + 8e0)) AS distance FROM s
    WHERE distance >= 80 AND distance < 500 AND 1.0 * (sx * 16 + 16) - 0.5 >= 0""",
)
def superchunk_band(spark, sf_dir):
    s = world.super_chunks(voxels(spark, sf_dir)).select("sx", "sy", "sz").distinct()
    x, y, z = (F.col(f"s{a}") * 16 + F.lit(8.0) + e for a, e in zip("xyz", (100, 0, 0), strict=True))
    seen = world.visible(s, PLANES[:1], size=16.0, prefix="s", scale=16)
    return seen.withColumn("distance", F.sqrt(x * x + y * y + z * z)).where((F.col("distance") >= 80) & (F.col("distance") < 500))


@register("lod_bands", FOLD + """, c AS (SELECT DISTINCT cx, cy, cz FROM folded), d AS (SELECT *, sqrt((cx + 0.5e0 - 30) * (cx + 0.5e0 - 30) + (cy * 12 + 0.5e0) * (cy * 12 + 0.5e0) + (cz + 0.5e0) * (cz + 0.5e0)) AS distance FROM (SELECT cx, cy, cz FROM c))
    SELECT cx, cy, cz, round(distance, 6) AS distance, CASE WHEN distance < 10 THEN 5 WHEN distance < 30 THEN 4 WHEN distance < 80 THEN 3 ELSE 1 END AS depth,
    CASE WHEN distance < 10 THEN 0.03125e0 WHEN distance < 30 THEN 0.0625e0 WHEN distance < 80 THEN 0.125e0 ELSE 0.5e0 END AS size FROM d""".replace("cy * 12", "cy"))
def lod_bands(spark, sf_dir):
    chunks = voxels(spark, sf_dir).select("cx", "cy", "cz").distinct()
    return rays.lod_depth(chunks, (30.0, 0.0, 0.0)).withColumn("distance", F.round("distance", 6))


@register("occupied_near", FOLD + f"SELECT x, y, z FROM (SELECT {_CENTRES} FROM folded WHERE log_odds > 0) WHERE (x - 1) * (x - 1) + (y - 3) * (y - 3) + (z - 0.5) * (z - 0.5) <= 2.25")
def occupied_near(spark, sf_dir):
    return world.near(voxels(spark, sf_dir), (1.0, 3.0, 0.5), 1.5).select("x", "y", "z")


@register(
    "chunk_keys",
    f"WITH lidar AS ({view_sql('lidar')})" + """ SELECT CAST(floor(x) AS SMALLINT) AS cx, CAST(floor(y) AS SMALLINT) AS cy, CAST(floor(z) AS SMALLINT) AS cz, CAST(floor(floor(y) / 16.0) AS SMALLINT) AS sy,
    CAST(floor((x - floor(x)) * 32) AS SMALLINT) AS ix, CAST(floor((x - floor(x)) * 32) AS BIGINT) % 2 + 2 * (CAST(floor((y - floor(y)) * 32) AS BIGINT) % 2) + 4 * (CAST(floor((z - floor(z)) * 32) AS BIGINT) % 2) AS octant, count(*) AS n FROM lidar GROUP BY ALL""",
)
def chunk_keys(spark, sf_dir):
    at = fold.keyed(view(spark, sf_dir, "lidar"))
    return at.groupBy("cx", "cy", "cz", keys.super_chunk(F.col("cy")).alias("sy"), "ix", keys.octant(F.col("ix"), F.col("iy"), F.col("iz")).cast("long").alias("octant")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "pack_unpack",
    f"WITH obs AS ({view_sql('obs')}), p AS (SELECT seq, CAST(r * 16777216 + g * 65536 + b * 256 + layer * 64 + class_id % 64 AS BIGINT) AS cf FROM obs)"
    " SELECT seq, cf, cf >> 24 & 255 AS r, cf >> 16 & 255 AS g, cf >> 8 & 255 AS b, CASE WHEN cf >> 6 & 3 <= 2 THEN cf >> 6 & 3 ELSE 0 END AS layer, cf & 63 AS class_id FROM p",
)
def pack_unpack(spark, sf_dir):
    cf = keys.pack(*(F.col(c) for c in ("r", "g", "b", "layer", "class_id")))
    return view(spark, sf_dir, "obs").select("seq", cf.alias("cf")).select("seq", "cf", *(c.cast("long").alias(n) for n, c in keys.unpack(F.col("cf")).items()))


def _bands(channel: int) -> str:
    # fixed values, spelt out for the checking engine: red, green and blue
    bands = (
        "CASE WHEN h < -0.15 THEN 220 WHEN h < 0.04 THEN 80 WHEN h < 0.45 THEN 55 WHEN h < 1.1 THEN 225 WHEN h < 2.0 THEN 220 ELSE 110 END",
        "CASE WHEN h < -0.15 THEN 40 WHEN h < 0.04 THEN 100 WHEN h < 0.45 THEN 185 WHEN h < 1.1 THEN 185 WHEN h < 2.0 THEN 90 ELSE 120 END",
        "CASE WHEN h < -0.15 THEN 40 WHEN h < 0.04 THEN 160 WHEN h < 0.45 THEN 90 WHEN h < 1.1 THEN 45 WHEN h < 2.0 THEN 45 ELSE 210 END",
    )
    return bands[channel]


@register("height_color", f"WITH obs AS ({view_sql('obs')}) SELECT seq, " + ", ".join(f"{_bands(i)} AS {c}" for i, c in enumerate("rgb")) + " FROM (SELECT seq, y * 0.5e0 - 0.5e0 AS h FROM obs)")
def height_color(spark, sf_dir):
    h = F.col("y") * 0.5 - 0.5
    return view(spark, sf_dir, "obs").select("seq", *(colour.height_colour(h, i).alias(c) for i, c in enumerate("rgb")))


_NV = {"r": "1.164e0 * (r - 16) + 1.596e0 * (b - 128)", "g": "1.164e0 * (r - 16) - 0.392e0 * (g - 128) - 0.813e0 * (b - 128)", "b": "1.164e0 * (r - 16) + 2.017e0 * (g - 128)"}


@register("nv12_rgb", f"WITH obs AS ({view_sql('obs')}) SELECT seq, " + ", ".join(f"greatest(0, least(255, CAST(trunc({e}) AS INTEGER))) AS {c}" for c, e in _NV.items()) + " FROM obs")
def nv12_rgb(spark, sf_dir):
    rgb = colour.studio_rgb(F.col("r"), F.col("g"), F.col("b"))
    return view(spark, sf_dir, "obs").select("seq", *(c.alias(n) for n, c in zip("rgb", rgb, strict=True)))


@register(
    "shader_rgb",
    f"""WITH obs AS ({view_sql('obs')}), s AS (SELECT seq, (r / 256e0 - 16e0 / 255e0) * (255e0 / 219e0) AS l, g / 256e0 - 0.5e0 AS u, b / 256e0 - 0.5e0 AS v FROM obs)
    SELECT seq, round(greatest(0e0, least(1e0, l + 1.402e0 * v)), 6) AS r, round(greatest(0e0, least(1e0, l - 0.344136e0 * u - 0.714136e0 * v)), 6) AS g, round(greatest(0e0, least(1e0, l + 1.772e0 * u)), 6) AS b FROM s""",
)
def shader_rgb(spark, sf_dir):
    rgb = colour.shader_rgb(*(F.col(c) / F.lit(256.0) for c in "rgb"))
    return view(spark, sf_dir, "obs").select("seq", *(F.round(c, 6).alias(n) for n, c in zip("rgb", rgb, strict=True)))


@register("aabb_intersects", f"WITH d AS ({view_sql('detections')}) SELECT det_id FROM d WHERE bx <= 1 AND bx + w >= 0.5 AND by0 <= 0.75 AND by0 + h >= 0.25 AND distance <= 60 AND distance + 1 >= 40")
def aabb_intersects(spark, sf_dir):
    return world.intersecting(_boxes(spark, sf_dir), (0.5, 0.25, 40.0), (1.0, 0.75, 60.0)).select("det_id")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "detections")
    return d.selectExpr("det_id", "bx min_x", "bx + w max_x", "by0 min_y", "by0 + h max_y", "distance min_z", "distance + 1 max_z")


@register("aabb_metrics", f"WITH d AS ({view_sql('detections')}) SELECT det_id, w AS size_x, h AS size_y, 1e0 AS size_z, (bx + (bx + w)) / 2 AS mid_x, (by0 + (by0 + h)) / 2 AS mid_y, (distance + (distance + 1)) / 2 AS mid_z, w * h AS volume FROM d")
def aabb_metrics(spark, sf_dir):
    return world.box_metrics(_boxes(spark, sf_dir)).drop("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")


@register("aabb_union", f"WITH d AS ({view_sql('detections')}) SELECT class_id, min(bx) AS min_x, max(bx + w) AS max_x, min(by0) AS min_y, max(by0 + h) AS max_y FROM d GROUP BY class_id")
def aabb_union(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    return d.groupBy("class_id").agg(F.min("bx").alias("min_x"), F.max(F.expr("bx + w")).alias("max_x"), F.min("by0").alias("min_y"), F.max(F.expr("by0 + h")).alias("max_y"))


@register("preview_top_down", f"WITH c AS ({view_sql('cloud')}), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM c) SELECT vec_id, round((x - lx) / greatest(hx - lx, hz - lz, 0.001e0), 6) AS px, round((z - lz) / greatest(hx - lx, hz - lz, 0.001e0), 6) AS pz, round((y - ly) / greatest(hy - ly, 0.001e0), 6) AS hue FROM c, b")
def preview_top_down(spark, sf_dir):
    return world.top_down(view(spark, sf_dir, "cloud")).select("vec_id", *(F.round(c, 6).alias(c) for c in ("px", "pz", "hue")))


# --- spatial joins ----------------------------------------------------------

_CLOUD = f"WITH cloud AS ({view_sql('cloud')})"
_D2 = "(q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)"


@register("knn3", _CLOUD + f" SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id FROM (SELECT q.vec_id AS query_id, p.vec_id AS point_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2}, p.vec_id) AS rank FROM cloud q JOIN cloud p ON q.vec_id <> p.vec_id) WHERE rank <= 3")
def knn3(spark, sf_dir):
    c = view(spark, sf_dir, "cloud")
    return spatial.nearest(c, c, 3, qid="vec_id", pid="vec_id", exclude_self=True).drop("d2")


@register("nearest", _CLOUD + f" SELECT query_id, point_id FROM (SELECT q.vec_id AS query_id, p.vec_id AS point_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2}, p.vec_id) AS rank FROM cloud q JOIN cloud p ON p.vec_id <> q.vec_id) WHERE rank = 1")
def nearest(spark, sf_dir):
    """Every point asks, all others answer."""
    c = view(spark, sf_dir, "cloud")
    return spatial.nearest(c, c, 1, qid="vec_id", pid="vec_id", exclude_self=True).select("query_id", "point_id")


@register("radius_join", _CLOUD + f" SELECT q.vec_id AS query_id, p.vec_id AS point_id FROM cloud q JOIN cloud p ON {_D2} <= 0.0625e0")
def radius_join(spark, sf_dir):
    c = view(spark, sf_dir, "cloud")
    return spatial.within(c, c, 0.25, qid="vec_id", pid="vec_id").select("query_id", "point_id")


_CELLS = " AND ".join(f"abs(floor(q.{a} / 0.5e0) - floor(p.{a} / 0.5e0)) <= 1" for a in "xyz")


@register(
    "outlier_removal",
    _CLOUD
    + f""", d AS (SELECT q.vec_id, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2}, p.vec_id) AS rank FROM cloud q JOIN cloud p ON q.vec_id <> p.vec_id AND {_CELLS}),
    m AS (SELECT vec_id, avg(d) AS mean FROM d WHERE rank <= 6 GROUP BY vec_id) SELECT vec_id FROM m WHERE mean <= (SELECT avg(mean) + 1.5 * stddev_pop(mean) FROM m)""",
)
def outlier_removal(spark, sf_dir):
    return spatial.without_outliers(view(spark, sf_dir, "cloud"), pid="vec_id", cell=0.5).select("vec_id")


@register("plane_hist", _CLOUD + " SELECT CAST(floor(z / 0.05e0) AS BIGINT) AS bin, count(*) AS n FROM cloud GROUP BY 1 HAVING count(*) >= 4")
def plane_hist(spark, sf_dir):
    return spatial.heights(view(spark, sf_dir, "cloud")).where(F.col("n") >= spatial.DENSE)


_PLANES = """, h AS (SELECT CAST(floor(z / 0.05e0) AS BIGINT) AS bin, count(*) AS n FROM cloud GROUP BY 1 HAVING count(*) >= 4 ORDER BY n DESC, bin LIMIT 6),
    e AS (SELECT bin, (bin + 0.5e0) * 0.05e0 AS mid FROM h),
    b AS (SELECT bin, mid, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cloud, e WHERE abs(z - mid) <= 0.025e0 GROUP BY bin, mid HAVING count(*) >= 4)"""


@register("plane_boxes", _CLOUD + _PLANES + " SELECT bin, n, round((x1 + x0) / 2 - least(x1 - x0, 8e0) / 2, 6) AS lo_x, round((x1 + x0) / 2 + least(x1 - x0, 8e0) / 2, 6) AS hi_x FROM b")
def plane_boxes(spark, sf_dir):
    return spatial.planes(view(spark, sf_dir, "cloud")).select("bin", "n", F.round("lo_x", 6).alias("lo_x"), F.round("hi_x", 6).alias("hi_x"))


@register(
    "plane_fill",
    _CLOUD
    + _PLANES
    + """, c AS (SELECT bin, (x1 + x0) / 2 - least(x1 - x0, 8e0) / 2 AS lx, (x1 + x0) / 2 + least(x1 - x0, 8e0) / 2 AS hx, (y1 + y0) / 2 - least(y1 - y0, 8e0) / 2 AS ly, (y1 + y0) / 2 + least(y1 - y0, 8e0) / 2 AS hy FROM b)
    SELECT bin, CAST((floor((hx - lx) / 0.25e0) + 1) * (floor((hy - ly) / 0.25e0) + 1) AS BIGINT) AS cells FROM c WHERE hx - lx > 0.25 AND hy - ly > 0.25""",
)
def plane_fill(spark, sf_dir):
    return spatial.plane_cells(view(spark, sf_dir, "cloud"), 0.25).groupBy("bin").agg(F.count(F.lit(1)).alias("cells"))


@register("lowest_plane", _CLOUD + " SELECT (min(bin) + 0.5e0) * 0.05e0 AS z FROM (SELECT CAST(floor(z / 0.05e0) AS BIGINT) AS bin FROM cloud GROUP BY 1 HAVING count(*) >= 10)")
def lowest_plane(spark, sf_dir):
    return spatial.lowest_plane(view(spark, sf_dir, "cloud"))


# --- rays and rasters -------------------------------------------------------

_MARCH = f"""WITH rays AS ({view_sql('rays')}), r1 AS (SELECT *, coalesce(hit_distance, 10e0) AS reach FROM rays), r2 AS (SELECT *, reach / 2 AS mid FROM r1 WHERE reach > 0),
    r3 AS (SELECT *, CASE WHEN mid < 10 THEN 0.03125e0 WHEN mid < 30 THEN 0.0625e0 WHEN mid < 80 THEN 0.125e0 ELSE 0.5e0 END AS step FROM r2),
    r4 AS (SELECT *, CASE WHEN hit_distance IS NOT NULL THEN greatest(0, hit_distance - 2 * step) ELSE 10e0 END AS stop FROM r3),
    r5 AS (SELECT *, CAST(floor(stop / step) AS BIGINT) AS steps FROM r4), r6 AS (SELECT *, least(steps, CASE WHEN mid < 10 THEN 512 ELSE 256 END) AS most FROM r5),
    r7 AS (SELECT *, CASE WHEN most > 0 THEN greatest(1, steps // most) ELSE 1 END AS stride, coalesce(CAST(hit_distance <= 10 AS BIGINT), 0) AS hits FROM r6)"""


@register("ray_carve_counts", _MARCH + " SELECT ray_id, CAST(steps AS INTEGER) AS steps, CAST(stride AS INTEGER) AS stride, CASE WHEN steps >= 1 THEN (steps - 1) // stride + 1 ELSE 0 END AS carved, hits FROM r7")
def ray_carve_counts(spark, sf_dir):
    return rays.marched(view(spark, sf_dir, "rays")).select("ray_id", "steps", "stride", "carved", "hits")


@register("ray_totals", _MARCH + " SELECT count(*) AS n, CAST(sum(CASE WHEN steps >= 1 THEN (steps - 1) // stride + 1 ELSE 0 END) AS BIGINT) AS carved, CAST(sum(hits) AS BIGINT) AS hits FROM r7")
def ray_totals(spark, sf_dir):
    return rays.marched(view(spark, sf_dir, "rays")).agg(F.count(F.lit(1)).alias("n"), F.sum("carved").alias("carved"), F.sum("hits").alias("hits"))


@register("ray_carve_samples", _MARCH + ", s AS (SELECT ray_id, dx, dy, dz, unnest(range(1, steps + 1, stride)) * step AS t, false AS hit FROM r7 UNION ALL SELECT ray_id, dx, dy, dz, hit_distance, true FROM r7 WHERE hits = 1) SELECT CAST(floor(dx * t) AS SMALLINT) AS cx, CAST(floor(dy * t) AS SMALLINT) AS cy, CAST(floor(dz * t) AS SMALLINT) AS cz, hit, count(*) AS n FROM s GROUP BY ALL")
def ray_carve_samples(spark, sf_dir):
    s = rays.samples(view(spark, sf_dir, "rays"))
    return s.groupBy(*(keys.chunk(F.col(a)).alias(f"c{a}") for a in "xyz"), "hit").agg(F.count(F.lit(1)).alias("n"))


@register(
    "ray_carve_fold",
    _MARCH
    + """, s AS (SELECT ray_id, dx, dy, dz, unnest(range(1, steps + 1, stride)) AS i, step, false AS hit FROM r7 UNION ALL SELECT ray_id, dx, dy, dz, 2147483647, hit_distance / 2147483647, true FROM r7 WHERE hits = 1),
    p AS (SELECT ray_id, i, hit, CASE WHEN hit THEN round(i * step * 4) / 4 ELSE i * step END AS t, dx, dy, dz FROM s),
    k AS (SELECT ray_id * 2147483648 + i AS seq, hit, floor(dx * t * 32) AS x, floor(dy * t * 32) AS y, floor(dz * t * 32) AS z FROM p),
    f AS (SELECT x, y, z, list_reduce(list_prepend(0::FLOAT, list(CASE WHEN hit THEN 0.85::FLOAT ELSE -0.7::FLOAT END ORDER BY seq)), lambda a, e: greatest(-2::FLOAT, least(3.5::FLOAT, a + e))) AS l FROM k GROUP BY x, y, z)
    SELECT l AS log_odds, count(*) AS voxels FROM f GROUP BY l""",
)
def ray_carve_fold(spark, sf_dir):
    """Carving folded into the map: per voxel in order of ray and sample, hits last."""

    def carve(part: DataFrame) -> DataFrame:
        return rays.samples(part).withColumn("seq", F.col("ray_id") * (1 << 31) + F.col("i"))

    shape = tuple(f"{n}{a}" for n in "od" for a in "xyz") + ("hit_distance",)
    return runs.carved(view(spark, sf_dir, "rays"), "ray_id", carve, shape).groupBy("log_odds").agg(F.count(F.lit(1)).alias("voxels"))


_DIST = "sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz))"


@register("scan_samples", f"WITH lidar AS ({view_sql('lidar')}) SELECT frame_id, CAST(sum(greatest(0, least(CAST(floor({_DIST} / res) AS BIGINT) - 1, 25))) AS BIGINT) AS misses, count(*) AS hits FROM lidar GROUP BY frame_id")
def scan_samples(spark, sf_dir):
    s = rays.scan_samples(view(spark, sf_dir, "lidar"))
    return s.groupBy("frame_id").agg(F.count_if(~F.col("hit")).alias("misses"), F.count_if("hit").alias("hits"))


@register("coloured_carve", f"WITH c AS ({view_sql('cloud')}), d AS (SELECT vec_id, sqrt((x - 2e0) * (x - 2e0) + (y - 3e0) * (y - 3e0) + (z - 0.5e0) * (z - 0.5e0)) AS dist FROM c) SELECT vec_id, CASE WHEN dist - 0.05e0 > 0.3e0 THEN least(CAST(floor((dist - 0.05e0 - 0.3e0) / 0.05e0) AS INTEGER), 50) ELSE 0 END AS k FROM d")
def coloured_carve(spark, sf_dir):
    return rays.carved_points(view(spark, sf_dir, "cloud"), EYE).select("vec_id", "k")


@register("solid_region", f"WITH d AS ({view_sql('detections')}) SELECT det_id, CAST((floor(bx + w) - floor(bx) + 1) * (floor(by0 + h) - floor(by0) + 1) * 2 AS BIGINT) AS chunks FROM d")
def solid_region(spark, sf_dir):
    return rays.solid_chunks(_boxes(spark, sf_dir)).groupBy("det_id").agg(F.count(F.lit(1)).alias("chunks"))


_PIX = f"WITH pixels AS ({view_sql('pixels')})"


@register("depth_unproject", _PIX + " SELECT frame_id, u, v, (u - 8e0) / 8e0 * d AS x, (v - 6e0) / 8e0 * d AS y, d AS z FROM pixels WHERE u % 2 = 0 AND v % 2 = 0 AND d BETWEEN 1 AND 8")
def depth_unproject(spark, sf_dir):
    return rays.depth_points(view(spark, sf_dir, "pixels"), CAM, stride=2, nearest=1.0, farthest=8.0).select("frame_id", "u", "v", "x", "y", "z")


@register("depth_rays", _PIX + ", n AS (SELECT frame_id, u, v, d, sqrt(((u - 8e0) / 8e0) * ((u - 8e0) / 8e0) + ((v - 6e0) / 8e0) * ((v - 6e0) / 8e0) + 1) AS n FROM pixels WHERE u % 4 = 0 AND v % 4 = 0 AND d > 0.1 AND d < 100) SELECT frame_id, u, v, round((u - 8e0) / 8e0 / n, 6) AS dx, round((v - 6e0) / 8e0 / n, 6) AS dy, round(1 / n, 6) AS dz, d AS hit_distance FROM n")
def depth_rays(spark, sf_dir):
    r = rays.depth_rays(view(spark, sf_dir, "pixels"), CAM)
    return r.select("frame_id", "u", "v", *(F.round(c, 6).alias(c) for c in ("dx", "dy", "dz")), "hit_distance")


def _undistorted() -> str:
    out = "u0 AS (SELECT det_id, (bx * 640 - 640e0) / 460e0 AS x0, (by0 * 360 - 360e0) / 460e0 AS y0 FROM d), s0 AS (SELECT *, x0 AS x, y0 AS y FROM u0)"
    for i in range(camera.ROUNDS):
        out += f", s{i + 1} AS (SELECT det_id, x0, y0, x0 / f AS x, y0 / f AS y FROM (SELECT *, 1 + -0.25e0 * r + 0.06e0 * (r * r) AS f FROM (SELECT *, x * x + y * y AS r FROM s{i})))"
    return out


@register("undistort5", f"WITH d AS ({view_sql('detections')}), {_undistorted()} SELECT det_id, round(x * 460e0 + 640e0, 6) AS u, round(y * 460e0 + 360e0, 6) AS v FROM s5")
def undistort5(spark, sf_dir):
    u, v = camera.undistort(F.col("bx") * 640, F.col("by0") * 360, K.CAMERAS["robot_dog"])
    return view(spark, sf_dir, "detections").select("det_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@register("unproject_lens", f"WITH d AS ({view_sql('detections')}), {_undistorted()} SELECT det_id, round(x * distance, 6) AS x, round(y * distance, 6) AS y, distance AS z FROM s5 JOIN d USING (det_id)")
def unproject_lens(spark, sf_dir):
    """Pixels of a lens with distortion, at a depth."""
    xyz = camera.unproject(F.col("bx") * 640, F.col("by0") * 360, F.col("distance"), K.CAMERAS["robot_dog"])
    return view(spark, sf_dir, "detections").select("det_id", F.round(xyz[0], 6).alias("x"), F.round(xyz[1], 6).alias("y"), xyz[2].alias("z"))


@register(
    "frame_results",
    _PIX
    + """, r AS (SELECT frame_id, d AS reach FROM pixels WHERE u % 4 = 0 AND v % 4 = 0 AND d > 0.1 AND d < 100), s AS (SELECT *, CAST(floor(greatest(0, reach - 0.0625e0) / 0.03125e0) AS BIGINT) AS steps FROM r),
    t AS (SELECT *, greatest(1, steps // greatest(1, least(steps, 512))) AS stride FROM s)
    SELECT frame_id, count(*) AS rays, CAST(sum(CASE WHEN steps >= 1 THEN (steps - 1) // stride + 1 ELSE 0 END) AS BIGINT) AS carved, count(*) AS hits FROM t GROUP BY frame_id""",
)
def frame_results(spark, sf_dir):
    """Frames through the composed step, each from its own pose."""
    from cairn.operators.frames import Pipeline

    poses = view(spark, sf_dir, "poses").where("pose_id <= 8").withColumn("frame_id", F.col("pose_id") - 1)
    boxes = _boxes(spark, sf_dir).selectExpr("det_id % 8 frame_id", "det_id", "1 class_id", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z")
    return Pipeline(fast=lambda p: p).process(view(spark, sf_dir, "pixels"), boxes, poses, CAM)["frames"]


@register("project_pixels", f"WITH c AS ({view_sql('cloud')}), p AS (SELECT vec_id, 8e0 * x / (z + 1) + 8e0 AS u, 8e0 * y / (z + 1) + 6e0 AS v, z + 1 AS d FROM c) SELECT vec_id, CASE WHEN d > 0 AND u >= 0 AND u < 16 AND v >= 0 AND v < 12 THEN round(u, 6) END AS u, CASE WHEN d > 0 AND u >= 0 AND u < 16 AND v >= 0 AND v < 12 THEN round(v, 6) END AS v FROM p")
def project_pixels(spark, sf_dir):
    u, v = camera.project(F.col("x"), F.col("y"), F.col("z") + 1, CAM)
    return view(spark, sf_dir, "cloud").select("vec_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@register(
    "color_project",
    f"""WITH c AS ({view_sql('cloud')}), pixels AS ({view_sql('pixels')}), one AS (SELECT u, v, max(r) AS r, max(g) AS g, max(b) AS b FROM pixels GROUP BY u, v),
    p AS (SELECT vec_id, z + 1 AS d, 8e0 * x / (z + 1) + 8e0 AS u, 8e0 * y / (z + 1) + 6e0 AS v FROM c)
    SELECT vec_id, one.r, one.g, one.b FROM p JOIN one ON CAST(floor(p.u) AS BIGINT) = one.u AND CAST(floor(p.v) AS BIGINT) = one.v WHERE d > 0.05 AND p.u >= 0 AND p.u < 16 AND p.v >= 0 AND p.v < 12""",
)
def color_project(spark, sf_dir):
    raster = view(spark, sf_dir, "pixels").groupBy("u", "v").agg(*(F.max(c).alias(c) for c in "rgb"))
    pose = (0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0)
    return rays.coloured(view(spark, sf_dir, "cloud"), raster, CAM, pose).select("vec_id", "r", "g", "b")


@register(
    "pose_transform",
    f"""WITH p AS ({view_sql('poses')}), d AS ({view_sql('detections')}), j AS (SELECT det_id, pose_id, px, py, pz, qx, qy, qz, qw, w AS x, h AS y, distance AS z FROM d JOIN p ON det_id % 10 + 1 = pose_id),
    t AS (SELECT *, 2 * (qy * z - qz * y) AS tx, 2 * (qz * x - qx * z) AS ty, 2 * (qx * y - qy * x) AS tz FROM j)
    SELECT det_id, pose_id, x + qw * tx + qy * tz - qz * ty + px AS x, y + qw * ty + qz * tx - qx * tz + py AS y, z + qw * tz + qx * ty - qy * tx + pz AS z FROM t""",
)
def pose_transform(spark, sf_dir):
    p, d = view(spark, sf_dir, "poses"), view(spark, sf_dir, "detections")
    j = d.withColumn("pose_id", F.col("det_id") % 10 + 1).join(p, "pose_id")
    xyz = camera.transform(tuple(F.col(f"q{a}") for a in "xyzw"), tuple(F.col(f"p{a}") for a in "xyz"), (F.col("w"), F.col("h"), F.col("distance")))
    return j.select("det_id", "pose_id", *(c.alias(a) for a, c in zip("xyz", xyz, strict=True)))


_FLOW = f"WITH flow AS ({view_sql('flow')}), g AS (SELECT * FROM flow WHERE u % 4 = 0 AND v % 4 = 0 AND sqrt(fx * fx + fy * fy) < 100), m AS (SELECT frame_id, avg(fx) AS dx, avg(fy) AS dy, avg(sqrt(fx * fx + fy * fy)) AS magnitude FROM g GROUP BY frame_id)"


@register("flow_mean", _FLOW + " SELECT f.frame_id, round(coalesce(dx, 0), 6) AS dx, round(coalesce(dy, 0), 6) AS dy, round(coalesce(magnitude, 0), 6) AS magnitude FROM (SELECT DISTINCT frame_id FROM flow) f LEFT JOIN m USING (frame_id)")
def flow_mean(spark, sf_dir):
    return rays.flow_means(view(spark, sf_dir, "flow")).select("frame_id", *(F.round(c, 6).alias(c) for c in ("dx", "dy", "magnitude")))


@register("parallax_depth", _FLOW + ", p AS (SELECT g.*, sqrt((fx - dx) * (fx - dx) + (fy - dy) * (fy - dy)) AS p FROM g JOIN m USING (frame_id)) SELECT frame_id, u, v, fx, fy, round(greatest(0.3e0, least(8e0, 80e0 / p)), 5) AS depth FROM p WHERE p >= 0.15")
def parallax_depth(spark, sf_dir):
    return rays.parallax(view(spark, sf_dir, "flow"), focal=4.0).select("frame_id", "u", "v", "fx", "fy", F.round("depth", 5).alias("depth"))


@register(
    "flow_correspondences",
    f"WITH flow AS ({view_sql('flow')}), p AS (SELECT frame_id, u, v, fx, fy, u * 2e0 + 1e0 AS u2, v * 2e0 + 1e0 AS v2 FROM flow WHERE u % 3 = 1 AND v % 3 = 1 AND sqrt(fx * fx + fy * fy) >= 0.2 AND sqrt(fx * fx + fy * fy) < 100)"
    " SELECT frame_id, u, v, (u2 + fx * 2 - 64) / 64 AS x1, (v2 + fy * 2 - 48) / 64 AS y1, (u2 - 64) / 64 AS x2, (v2 - 48) / 64 AS y2 FROM p WHERE u2 + fx * 2 >= 0 AND u2 + fx * 2 < 128 AND v2 + fy * 2 >= 0 AND v2 + fy * 2 < 96",
)
def flow_correspondences(spark, sf_dir):
    return rays.correspondences(view(spark, sf_dir, "flow"), (64.0, 64.0, 64.0, 48.0, 128, 96), 64, 48)


# --- detections and refinement ----------------------------------------------

# The size priors, spelt out for the checking engine.
_PRIORS = """priors(class_id, label, pw, ph, pd, variance, layer) AS (VALUES
  (1, 'person', 0.5e0, 1.7e0, 0.3e0, 0.3e0, 2),
  (2, 'bicycle', 0.5e0, 1.0e0, 1.8e0, 0.2e0, 2),
  (3, 'car', 1.8e0, 1.5e0, 4.5e0, 0.3e0, 0),
  (4, 'motorcycle', 0.8e0, 1.1e0, 2.2e0, 0.2e0, 2),
  (5, 'bus', 2.5e0, 3.2e0, 12.0e0, 0.3e0, 0),
  (6, 'truck', 2.5e0, 3.0e0, 8.0e0, 0.4e0, 0),
  (7, 'dog', 0.3e0, 0.5e0, 0.7e0, 0.4e0, 2),
  (8, 'cat', 0.2e0, 0.3e0, 0.4e0, 0.3e0, 2),
  (9, 'chair', 0.5e0, 0.9e0, 0.5e0, 0.2e0, 1),
  (10, 'dining table', 1.2e0, 0.75e0, 0.8e0, 0.3e0, 1),
  (11, 'couch', 2.0e0, 0.85e0, 0.9e0, 0.3e0, 1),
  (12, 'bed', 1.6e0, 0.6e0, 2.0e0, 0.3e0, 1),
  (13, 'potted plant', 0.4e0, 0.6e0, 0.4e0, 0.5e0, 1),
  (14, 'tv', 1.0e0, 0.6e0, 0.1e0, 0.4e0, 1),
  (15, 'door', 0.8e0, 2.0e0, 0.1e0, 0.15e0, 0),
  (16, 'window', 1.0e0, 1.2e0, 0.1e0, 0.3e0, 0),
  (17, 'wall', 3.0e0, 2.8e0, 0.2e0, 0.5e0, 0),
  (18, 'fire hydrant', 0.3e0, 0.7e0, 0.3e0, 0.1e0, 0),
  (19, 'stop sign', 0.6e0, 0.6e0, 0.05e0, 0.1e0, 0),
  (20, 'bench', 1.5e0, 0.8e0, 0.5e0, 0.2e0, 1),
  (21, 'parking meter', 0.3e0, 1.2e0, 0.3e0, 0.1e0, 0))"""


@register(
    "prior_blend",
    f"""WITH d AS ({view_sql('detections')}), {_PRIORS}, s AS (SELECT d.*, pw, ph, pd, coalesce(greatest(0e0, least((distance - 5e0) / 45e0, 1e0)) * (1e0 - variance), 0e0) AS share FROM d LEFT JOIN priors USING (class_id))
    SELECT det_id, class_id, round(w * (1e0 - share) + coalesce(pw, 0) * share, 6) AS bw, round(h * (1e0 - share) + coalesce(ph, 0) * share, 6) AS bh, round(least(w, h) * (1e0 - share) + coalesce(pd, 0) * share, 6) AS bd FROM s""",
)
def prior_blend(spark, sf_dir):
    return detect.blended(view(spark, sf_dir, "detections")).select("det_id", "class_id", *(F.round(c, 6).alias(c) for c in ("bw", "bh", "bd")))


@register("prior_lookup", f"WITH {_PRIORS}, d AS (SELECT p_partkey AS det_id, CASE p_size % 4 WHEN 0 THEN 'chair' WHEN 1 THEN 'car' WHEN 2 THEN 'class_7' ELSE 'dog' END AS label FROM part) SELECT det_id, label, CAST(coalesce(class_id, 0) AS BIGINT) AS class_id, layer AS prior_layer FROM d LEFT JOIN priors USING (label)")
def prior_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_partkey det_id", "CASE p_size % 4 WHEN 0 THEN 'chair' WHEN 1 THEN 'car' WHEN 2 THEN 'class_7' ELSE 'dog' END label")
    return detect.with_priors(d, "label").select("det_id", "label", "class_id", "prior_layer")


_SCORES = "CAST(p_partkey % 7 AS DOUBLE) / 8e0, CAST(p_size % 9 AS DOUBLE) / 8e0, CAST(p_partkey % 5 AS DOUBLE) / 4e0"


@register(
    "detect_argmax",
    f"WITH s AS (SELECT p_partkey AS det_id, [{_SCORES}] AS s FROM part), m AS (SELECT det_id, list_max(s) AS confidence, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS class FROM s) SELECT det_id, confidence, class, 'class_' || class AS label FROM m WHERE confidence >= 0.5",
)
def detect_argmax(spark, sf_dir):
    raw = table(spark, sf_dir, "part").selectExpr("p_partkey det_id", "0.5D cx", "0.5D cy", "0.25D w", "0.25D h", f"array({_SCORES}) scores")
    return detect.parsed(raw).select("det_id", "confidence", "class", "label")


@register("detection_filters", f"WITH d AS ({view_sql('detections')}), {_PRIORS} SELECT det_id, label FROM d JOIN priors USING (class_id) WHERE confidence >= 0.5 AND distance BETWEEN 5 AND 200 AND label IN ('car', 'truck', 'bus', 'motorcycle', 'bicycle', 'person', 'dog', 'cat', 'bench', 'fire hydrant', 'stop sign', 'parking meter', 'potted plant', 'chair', 'dining table')")
def detection_filters(spark, sf_dir):
    d = detect.with_priors(view(spark, sf_dir, "detections"))
    kept = d.where((F.col("confidence") >= detect.CONFIDENT) & F.col("distance").between(detect.NEAREST, detect.FARTHEST) & F.col("label").isin(*detect.OUTDOOR))
    return kept.select("det_id", "label")


@register("detection_median", f"WITH pixels AS ({view_sql('pixels')}), l AS (SELECT u, v, list_sort(list(d)) AS s FROM pixels WHERE d > 0.1 AND d < 200 GROUP BY u, v) SELECT u, v, s[len(s) // 2 + 1] AS median FROM l")
def detection_median(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").where("d > 0.1 and d < 200")
    return p.groupBy("u", "v").agg(detect.upper_median(F.collect_list("d")).alias("median"))


@register(
    "detection_project",
    f"""WITH d AS ({view_sql('detections')}), pixels AS ({view_sql('pixels')}), {_PRIORS}, raster AS (SELECT u, v, max(d) AS d FROM pixels GROUP BY u, v),
    box AS (SELECT det_id, class_id, CAST(floor(least(bx, 0.5e0) * 16) AS INTEGER) AS px, CAST(floor(least(by0, 0.5e0) * 12) AS INTEGER) AS py FROM d),
    hit AS (SELECT det_id, raster.d FROM box JOIN raster ON u >= px AND u < px + 8 AND v >= py AND v < py + 6 WHERE raster.d > 0.1 AND raster.d < 200),
    med AS (SELECT det_id, list_sort(list(d))[count(*) // 2 + 1] AS m FROM hit GROUP BY det_id),
    w AS (SELECT det_id, class_id, m, (px + 8 * 0.5e0 - 8e0) / 8e0 * m + 0e0 AS wx, (py + 6 * 0.5e0 - 6e0) / 8e0 * m + 0e0 AS wy, m + 0e0 AS wz, 8 / 8e0 * m AS w, 6 / 8e0 * m AS h FROM box JOIN med USING (det_id) WHERE m BETWEEN 5 AND 200),
    s AS (SELECT w.*, pw, ph, pd, coalesce(greatest(0e0, least((m - 5e0) / 45e0, 1e0)) * (1e0 - variance), 0e0) AS share FROM w LEFT JOIN priors USING (class_id)),
    b AS (SELECT *, w * (1e0 - share) + coalesce(pw, 0e0) * share AS bw, h * (1e0 - share) + coalesce(ph, 0e0) * share AS bh, least(w, h) * (1e0 - share) + coalesce(pd, 0e0) * share AS bd FROM s)
    SELECT det_id, class_id, m AS distance, wx + bw * -0.5e0 AS min_x, wx + bw * 0.5e0 AS max_x, wy + bh * -0.5e0 AS min_y, wy + bh * 0.5e0 AS max_y, wz + bd * -0.5e0 AS min_z, wz + bd * 0.5e0 AS max_z FROM b""",
)
def detection_project(spark, sf_dir):
    d = view(spark, sf_dir, "detections").selectExpr("det_id", "class_id", "least(bx, 0.5) bx", "least(by0, 0.5) by", "0.5D bw", "0.5D bh")
    raster = view(spark, sf_dir, "pixels").groupBy("u", "v").agg(F.max("d").alias("d"))
    return detect.projected(d, raster, CAM, 16, 12).select("det_id", "class_id", "distance", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z")


@register("refine_scan", FOLD + " SELECT cx, cy, cz, n AS voxels FROM (SELECT cx, cy, cz, count(*) FILTER (log_odds > 0) AS n FROM folded GROUP BY cx, cy, cz) WHERE n BETWEEN 1 AND 99")
def refine_scan(spark, sf_dir):
    """Chunks of under 100 occupied voxels: these maps are too dense for the usual bound."""
    return detect.thin_chunks(voxels(spark, sf_dir), thin=100)


_TASKS = "event_id AS seq, CAST(user_id % 20 AS SMALLINT) AS cx, CAST(user_id % 7 AS SMALLINT) AS cy, CAST(user_id % 3 AS SMALLINT) AS cz, CAST(event_id % 3 AS INTEGER) AS priority, floor(value) AS observations"


@register(
    "refine_topk",
    f"WITH t AS (SELECT {_TASKS} FROM events), f AS (SELECT cx, cy, cz, min(seq) AS seq, arg_min(priority, seq) AS priority, arg_min(CAST(observations AS DOUBLE), seq) AS observations FROM (SELECT * FROM t) t GROUP BY cx, cy, cz ORDER BY seq LIMIT 100) SELECT *, CAST(row_number() OVER (ORDER BY priority, observations, seq) AS INTEGER) AS place FROM f".replace("min(seq) AS seq,", "min(t.seq) AS seq,").replace("arg_min(priority, seq)", "arg_min(priority, t.seq)").replace("AS DOUBLE), seq)", "AS DOUBLE), t.seq)"),
)
def refine_topk(spark, sf_dir):
    tasks = table(spark, sf_dir, "events").selectExpr(*_TASKS.replace("floor(value)", "CAST(floor(value) AS DOUBLE)").split(", "))
    return detect.queue(tasks, 100)


@register("region_tasks", f"WITH d AS ({view_sql('detections')}) SELECT count(*) AS n FROM (SELECT DISTINCT x.x, y.y, z.z FROM d, unnest(range(CAST(floor(bx) AS BIGINT), CAST(floor(bx + w) AS BIGINT) + 1)) x(x), unnest(range(CAST(floor(by0) AS BIGINT), CAST(floor(by0 + h) AS BIGINT) + 1)) y(y), unnest(range(CAST(floor(distance) AS BIGINT), CAST(floor(distance + 1) AS BIGINT) + 1)) z(z))")
def region_tasks(spark, sf_dir):
    return detect.region_tasks(_boxes(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


_FRAMES = "user_id % 8 AS session, event_id AS seq, value % 100 < 2 AS fresh"


@register("idle_islands", f"WITH f AS (SELECT {_FRAMES} FROM events), i AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS island FROM f) SELECT session, CAST(island AS BIGINT) AS island, count(*) AS frames FROM i WHERE NOT fresh GROUP BY session, island HAVING count(*) > 60")
def idle_islands(spark, sf_dir):
    return detect.idle_runs(table(spark, sf_dir, "events").selectExpr(*_FRAMES.split(", ")), 60)


@register("frame_skip", "SELECT event_id, session FROM (SELECT event_id, user_id % 8 AS session, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS rn FROM events) WHERE rn % 10 = 0")
def frame_skip(spark, sf_dir):
    f = table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 8 session")
    return sequence.every(f, detect.EVERY, by="event_id")


@register("tick_delta", "SELECT user_id % 8 AS session, event_id AS seq, value - lag(value) OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS delta FROM events")
def tick_delta(spark, sf_dir):
    f = table(spark, sf_dir, "events").selectExpr("user_id % 8 session", "event_id seq", "value")
    return sequence.deltas(f, "value").select("session", "seq", "delta")


def _steps(columns: str, table_: str = "events", session: str = "user_id % 8", by: str = "event_id") -> str:
    """Rows of sessions in order, for a recursion over them."""
    return f"WITH RECURSIVE e AS MATERIALIZED (SELECT {session} AS session, {by} AS seq, row_number() OVER (PARTITION BY {session} ORDER BY {by}) AS rn, {columns} FROM {table_})"


@register(
    "fps_window",
    _steps("event_id / 64e0 AS t")
    + """, s AS (SELECT session, 0::BIGINT AS rn, 0e0 AS since, 0 AS n, false AS due, 0e0 AS "at", 0 AS frames, 0e0 AS fps FROM e GROUP BY session
      UNION ALL SELECT e.session, e.rn, CASE WHEN t - since >= 0.25 THEN t ELSE since END, CASE WHEN t - since >= 0.25 THEN 0 ELSE n + 1 END, t - since >= 0.25, t, n + 1, (n + 1) / (t - since) FROM s JOIN e ON e.session = s.session AND e.rn = s.rn + 1)
    SELECT session, row_number() OVER (PARTITION BY session ORDER BY rn) - 1 AS tick, "at", frames, round(fps, 6) AS fps FROM s WHERE due""",
)
def fps_window(spark, sf_dir):
    """Ticks of each session's frames, a frame every few hundredths of a second."""
    f = table(spark, sf_dir, "events").selectExpr("user_id % 8 session", "event_id / 64D t")
    return sequence.ticks(f).withColumn("fps", F.round("fps", 6))


@register(
    "smoothed_path",
    _FLOW.replace("WITH flow", "WITH RECURSIVE flow")
    + """, a AS (SELECT f.frame_id, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy, coalesce(magnitude, 0) AS m FROM (SELECT DISTINCT frame_id FROM flow) f LEFT JOIN m USING (frame_id)),
    e AS MATERIALIZED (SELECT frame_id % 4 AS session, row_number() OVER (PARTITION BY frame_id % 4 ORDER BY frame_id) AS rn, dx, dy, m, dx * dx + dy * dy AS l2, dx * 0.002e0 AS lx, -dy * 0.002e0 AS ly, sqrt(greatest(0e0, m * m - (dx * dx + dy * dy))) * 0.002e0 AS lz FROM a),
    s AS (SELECT session, 0::BIGINT AS rn, 0e0 AS x, 0e0 AS y, 0e0 AS z, 0e0 AS heading FROM e GROUP BY session
      UNION ALL SELECT e.session, e.rn, CASE WHEN m > 0.05 THEN 0.85e0 * x + 0.15e0 * (x + cos(heading) * lx + sin(heading) * lz) ELSE x END, CASE WHEN m > 0.05 THEN 0.85e0 * y + 0.15e0 * (y + ly) ELSE y END,
        CASE WHEN m > 0.05 THEN 0.85e0 * z + 0.15e0 * (z - sin(heading) * lx + cos(heading) * lz) ELSE z END, CASE WHEN m > 0.05 AND sqrt(l2) > 0.5 THEN heading + atan2(dy, dx) * 0.003e0 ELSE heading END FROM s JOIN e ON e.session = s.session AND e.rn = s.rn + 1)
    SELECT session, round(arg_max(x, rn), 6) AS x, round(arg_max(y, rn), 6) AS y, round(arg_max(z, rn), 6) AS z, round(arg_max(heading, rn), 6) AS heading FROM s GROUP BY session""",
)
def smoothed_path(spark, sf_dir):
    means = rays.flow_means(view(spark, sf_dir, "flow"))
    path = sequence.smoothed_path(means.selectExpr("frame_id % 4 session", "frame_id seq", "dx", "dy", "magnitude"))
    return path.select("session", *(F.round(c, 6).alias(c) for c in ("x", "y", "z", "heading")))


@register(
    "scale_median",
    _steps("(1 + value % 3) / (event_id % 4 + 0.5e0) AS ratio")
    + """, s AS (SELECT session, 0::BIGINT AS rn, CAST([] AS DOUBLE[]) AS kept, 1e0 AS scale FROM e GROUP BY session
      UNION ALL SELECT session, rn, kept, CASE WHEN len(kept) > 0 THEN list_sort(kept)[len(kept) // 2 + 1] ELSE 1e0 END FROM (
        SELECT e.session, e.rn, CASE WHEN len(kept) = 0 OR (ratio >= 0.33e0 * scale AND ratio <= 3e0 * scale) THEN list_append(kept, ratio)[-20:] ELSE kept END AS kept FROM s JOIN e ON e.session = s.session AND e.rn = s.rn + 1))
    SELECT session, round(arg_max(scale, rn), 6) AS scale, CAST(len(arg_max(kept, rn)) AS INTEGER) AS samples, len(arg_max(kept, rn)) >= 5 AS converged FROM s GROUP BY session""",
)
def scale_median(spark, sf_dir):
    s = table(spark, sf_dir, "events").selectExpr("user_id % 8 session", "event_id seq", "1 + value % 3 known", "event_id % 4 + 0.5D visual")
    return sequence.scales(s).withColumn("scale", F.round("scale", 6))


@register("short_forms", "SELECT c_custkey, CASE WHEN c_custkey * 976 >= 1000000 THEN printf('%.1fM', c_custkey * 976 / 1e6) WHEN c_custkey * 976 >= 1000 THEN printf('%.1fK', c_custkey * 976 / 1e3) ELSE CAST(c_custkey * 976 AS VARCHAR) END AS short, (c_custkey // 60) || ':' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') AS clock, CASE c_custkey % 4 WHEN 0 THEN 'Wide' WHEN 1 THEN 'Ultra-Wide' WHEN 2 THEN 'Dog' ELSE 'Unknown' END AS lens, CASE WHEN c_custkey % 3 > 0 THEN 0.5e0 / (c_custkey % 3) END AS fraction FROM customer")
def short_forms(spark, sf_dir):
    n = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", text.short_count(n * 976).alias("short"), text.minutes(n).alias("clock"), text.label(n % 4, text.CAMERA_LABELS, "Unknown").alias("lens"), text.fraction(F.lit(0.5), n % 3).alias("fraction"))


# --- grouped ----------------------------------------------------------------


@register("merged_voxels")
def merged_voxels(spark, sf_dir):
    v = voxels(spark, sf_dir).withColumn("cf", keys.pack(*(F.col(c) for c in ("r", "g", "b", "layer", "class_id"))))
    return grouped.cuboids(v, log_odds=0.4, observations=2)


@register("merged_world")
def merged_world(spark, sf_dir):
    """What is rendered from a point, unobserved nodes as solid, by levels of detail."""
    return grouped.rendered(voxels(spark, sf_dir), (30.0, 0.0, 0.0), PLANES[:1], subtractive=True)


@register("mesh_faces")
def mesh_faces(spark, sf_dir):
    return world.faces(merged_voxels(spark, sf_dir))


@register("icp")
def icp(spark, sf_dir):
    """Every eighth of the cloud, shifted, against the whole."""
    c = view(spark, sf_dir, "cloud")
    frames = c.selectExpr("vec_id % 4 frame_id", "x + 0.05 x", "y", "z")
    scene = c.withColumn("frame_id", F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))))
    return grouped.matched(frames, scene).select("frame_id", *(F.round(t, 4).alias(t) for t in ("tx", "ty", "tz")), "inliers", "converged")


@register("ransac_motion")
def ransac_motion(spark, sf_dir):
    pairs = rays.correspondences(view(spark, sf_dir, "flow"), (64.0, 64.0, 64.0, 48.0, 128, 96), 64, 48)
    return grouped.frame_motions(pairs).select("frame_id", "pairs", "inliers")


@register("subtractive_fold")
def subtractive_fold(spark, sf_dir):
    obs = fold.keyed(view(spark, sf_dir, "obs"))
    local = obs.select("cx", "cy", "cz", "seq", *((F.col(a) - F.col(f"c{a}")).alias(f"l{a}") for a in "xyz"), "hit", (F.col("seq") % 3 + 3).cast("int").alias("depth"))
    return grouped.subtractive(local)


@register("vio_replay")
def vio_replay(spark, sf_dir):
    """Pose fusion over sessions of mixed samples."""
    s = table(spark, sf_dir, "events").selectExpr(
        "user_id % 8 session", "event_id seq", "element_at(array('video', 'imu', 'encoder'), cast(event_id % 3 + 1 as int)) kind", "event_id / 64D t",
        "value / 100D px", "event_id / 1000D py", "0D pz", "0D qx", "0D qy", "0D qz", "1D qw", "0.5D vx", "0D vy", "0D vz",
    )
    from cairn.streaming.live import replay

    return replay(s).select("session", "seq", "state", *(F.round(c, 6).alias(c) for c in ("x", "y", "z", "scale")))


@register("map_file_roundtrip", FOLD + ", g AS (SELECT * FROM folded WHERE log_odds >= 0), v AS (SELECT DISTINCT cx, cy, cz, ix, iy, iz FROM g) SELECT cx, cy, cz, count(*) AS voxels, CAST(0.85::FLOAT * 1 AS FLOAT) AS log_odds FROM v GROUP BY cx, cy, cz")
def map_file_roundtrip(spark, sf_dir):
    """An export coded as map files and decoded again: every voxel comes back as one hit."""
    from cairn.sources import maps

    at = world.exported(voxels(spark, sf_dir)).withColumn("part", F.floor("y"))
    files = maps.maps_of(at, "part", name="round")

    def decode(batches):
        import pandas as pd

        for b in batches:
            for data in b["content"]:
                v = maps.decode_map(data)[1]
                yield pd.DataFrame({a: v[a].astype(float) for a in "xyz"} | {"seq": range(len(v)), "hit": True})

    back = fold.keyed(files.mapInPandas(decode, "x double, y double, z double, seq long, hit boolean"))
    leaves = back.groupBy(*fold.KEY).agg(fold.log_odds().alias("log_odds"))
    return leaves.groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("voxels"), F.max("log_odds").alias("log_odds"))


@register("map_records", FOLD + f"SELECT {_CENTRES}, {_CF} AS cf, CAST(least(65535, obs_count) AS BIGINT) AS obs, 3.4028234663852886e38::FLOAT AS sdf FROM folded WHERE log_odds >= 0")
def map_records(spark, sf_dir):
    """Whole records of map files: place, colour and layer, observations, signed distance."""
    from cairn.sources import maps

    at = world.exported(voxels(spark, sf_dir)).withColumn("part", F.floor("y"))

    def decode(batches):
        import pandas as pd

        for b in batches:
            for data in b["content"]:
                v = maps.decode_map(data)[1]
                yield pd.DataFrame({a: v[a].astype(float) for a in "xyz"} | {"cf": v["cf"].astype("int64"), "obs": v["obs"].astype("int64"), "sdf": v["sdf"]})

    return maps.maps_of(at, "part", name="records").mapInPandas(decode, "x double, y double, z double, cf long, obs long, sdf float")


@register("wire_roundtrip", f"WITH pixels AS ({view_sql('pixels')}) SELECT frame_id AS sequence, CAST(count(*) AS INTEGER) AS width FROM pixels WHERE d IS NOT NULL GROUP BY frame_id")
def wire_roundtrip(spark, sf_dir):
    """Frames with depth rasters, coded to length-prefixed messages and read back; a raster wider than a message's field goes as strips, a message each."""
    import numpy as np
    import pyarrow as pa

    from cairn.sources import wire

    def message(frame: int, depth: np.ndarray) -> pa.RecordBatch:
        f = wire.Frame(frame, 1.0, image=b"\xff\xd8", depth_width=len(depth), depth_height=1, depth=depth.tobytes())
        status = wire.prefixed(wire.encode_status((1, 2, 3, 4, 5, 6)))
        content = status + wire.prefixed(wire.encode_frame(f)) + wire.prefixed(wire.stop_marker()) + b"rest"
        return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    def encode(batches):
        frame, held = None, np.zeros(0, "<f2")
        for b in batches:
            ids, depth = (b.column(c).to_numpy() for c in ("frame_id", "d"))
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else []
            for a, z in zip(starts, [*starts[1:], len(ids)]):
                if len(held) and ids[a] != frame:
                    yield message(frame, held)
                    held = held[:0]
                frame, held = int(ids[a]), np.concatenate([held, depth[a:z].astype("<f2")])
                while len(held) >= wire.WIDEST:
                    yield message(frame, held[: wire.WIDEST])
                    held = held[wire.WIDEST :]
        if len(held):
            yield message(frame, held)

    # dealt by ranges, so that neither a frame nor a task's rows meet in one piece
    pixels = view(spark, sf_dir, "pixels").where("d is not null").select("frame_id", "u", "v", "d")
    order = ["frame_id", "u", "v", "d"]
    messages = pixels.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).mapInArrow(encode, "content binary")
    strips = wire.frames(messages).where("kind = 'frame' and length(depth) = 2 * depth_width")
    return strips.groupBy("sequence").agg(F.sum("depth_width").cast("int").alias("width"))


def _store(spark: SparkSession, sf_dir: str):
    """The observations stored in two batches, each into the super-chunks that it touches."""
    import uuid

    from cairn.sources.shared import shared_dir
    from cairn.sources.store import Store

    obs = view(spark, sf_dir, "obs")
    half = (obs.agg(F.max("seq")).first()[0] or 0) // 2
    store = Store(spark, f"{shared_dir(spark)}/map-{uuid.uuid4().hex}")
    for k, part in enumerate((F.col("seq") < half, F.col("seq") >= half)):
        store.insert(obs.where(part), ("obs", k))
    return store


@register("stored_batches", FOLD + "SELECT * FROM folded")
def stored_batches(spark, sf_dir):
    """A stored map after two batches."""
    return _store(spark, sf_dir).read().drop("key")


@register("stored_sphere", FOLD + f"SELECT x, y, z FROM (SELECT {_CENTRES} FROM folded WHERE log_odds > 0) WHERE (x - 1) * (x - 1) + (y - 3) * (y - 3) + (z - 0.5) * (z - 0.5) <= 2.25")
def stored_sphere(spark, sf_dir):
    """What a stored map holds about a point, by ranges of Morton keys."""
    return _store(spark, sf_dir).sphere((1.0, 3.0, 0.5), 1.5).where("log_odds > 0").select("x", "y", "z")


@register(
    "capture_chunks",
    "SELECT o_custkey AS session, o_orderkey AS sequence, CAST(o_orderkey % 1000 AS DOUBLE) AS x, CAST(o_custkey % 1000 AS DOUBLE) / 4e0 AS y, -0.5e0 AS z, o_orderkey % 256 AS r, o_custkey % 256 AS g, 7::BIGINT AS b FROM orders",
)
def capture_chunks(spark, sf_dir):
    """A session of frames a customer, as bytes that come in chunks of up to 61, put together again."""
    import pyarrow as pa
    from pyspark.sql import Window

    from cairn.sources import capture, wire
    from cairn.streaming import reassembly

    def encode(batches):
        for b in batches:
            out = []
            for session, sequence in zip(b.column("session").to_pylist(), b.column("sequence").to_pylist(), strict=True):
                point = struct.pack("<3f4B", sequence % 1000, session % 1000 / 4, -0.5, sequence % 256, session % 256, 7, 0)
                out.append(wire.prefixed(wire.encode_frame(wire.Frame(sequence, 1.0, points=point, point_count=1, flags=wire.COLOURED))))
            yield pa.RecordBatch.from_arrays([b.column("session"), b.column("sequence"), pa.array(out, pa.binary())], ["session", "sequence", "message"])

    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("sequence"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, so that the work on few bytes isn't merged into few tasks
    coded = orders.mapInArrow(encode, "session long, sequence long, message binary").repartition(parts, "session")
    before = Window.partitionBy("session").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    placed = coded.withColumn("start", F.col("session") + F.coalesce(F.sum(F.octet_length("message")).over(before), F.lit(0)))
    cut = placed.withColumn("skip", F.explode(F.expr("sequence(0, octet_length(message) - 1, 61)")))
    chunks = cut.select("session", (F.col("start") + F.col("skip")).alias("at"), F.expr("substring(message, skip + 1, 61)").alias("chunk"))
    return capture.world_points(reassembly.recorded(chunks), keep=("session",)).drop("i")


@register("pose_json", f"WITH p AS ({view_sql('poses')}) SELECT pose_id, px, py, pz, qx, qy, qz, qw FROM p")
def pose_json(spark, sf_dir):
    """Poses through JSON and back."""
    text_of = camera.pose_json(*(F.col(c) for c in camera.POSE))
    return view(spark, sf_dir, "poses").select("pose_id", camera.pose_of(text_of).alias("p")).select("pose_id", "p.*")


@register("pose_matrix", f"WITH p AS ({view_sql('poses')}) SELECT pose_id, qx AS x, qy AS y, qz AS z, qw AS w FROM p")
def pose_matrix(spark, sf_dir):
    """Quaternions through rotation matrices and back."""
    q = camera.quaternion(camera.matrix(tuple(F.col(f"q{a}") for a in "xyzw")))
    got = view(spark, sf_dir, "poses").select("pose_id", q.alias("q"))
    return got.select("pose_id", *((F.abs(F.element_at("q", i))).alias(a) for i, a in enumerate("xyzw", 1)))


@register("depth_lookup", f"WITH pixels AS ({view_sql('pixels')}) SELECT frame_id, u, v, CASE WHEN u < 8 AND v < 8 THEN (v * 8 + u) / 4e0 END AS depth FROM pixels")
def depth_lookup(spark, sf_dir):
    from cairn.functions import raster

    eight = F.lit(8)
    d = raster.depth_at(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i / 4), eight, eight, F.col("u"), F.col("v"))
    return view(spark, sf_dir, "pixels").select("frame_id", "u", "v", F.when(~F.isnan(d), d).alias("depth"))


@register("raster_colour", f"WITH pixels AS ({view_sql('pixels')}), s AS (SELECT frame_id, u, v, 20 + v * 16 + u AS l, 30 + (v // 2) * 16 + 2 * (u // 2) AS c FROM pixels) SELECT frame_id, u, v, CAST(l AS INTEGER) AS y, CAST(c AS INTEGER) AS cb, CAST(c + 1 AS INTEGER) AS cr FROM s")
def raster_colour(spark, sf_dir):
    from cairn.functions import raster

    luma, chroma = F.lit(bytes(range(20, 20 + 192))), F.lit(bytes(range(30, 30 + 96)))  # 16 x 12 pixels
    y, cb, cr = raster.nv12_at(luma, chroma, F.lit(16), F.col("u"), F.col("v"))
    return view(spark, sf_dir, "pixels").select("frame_id", "u", "v", y.alias("y"), cb.alias("cb"), cr.alias("cr"))


@register(
    "keyframes",
    _steps("value / 10e0 AS m")
    + """, s AS (SELECT session, 0::BIGINT AS rn, 0::BIGINT AS seq, 0e0 AS travel, 0 AS frames FROM e GROUP BY session
      UNION ALL SELECT e.session, e.rn, e.seq, CASE WHEN travel >= 0.15 OR frames >= 30 THEN 0e0 ELSE travel END + m * 0.002e0, CASE WHEN travel >= 0.15 OR frames >= 30 THEN 0 ELSE frames END + 1 FROM s JOIN e ON e.session = s.session AND e.rn = s.rn + 1)
    SELECT session, seq, frames, round(travel, 6) AS travel FROM s WHERE travel >= 0.15 OR frames >= 30""",
)
def keyframes(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id % 8 session", "event_id seq", "value / 10D magnitude")
    return sequence.keyframes(e).withColumn("travel", F.round("travel", 6))
