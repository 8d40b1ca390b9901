"""The fold, octree maintenance and spatial filters against small models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import constants as K
from cairn.functions import keys
from cairn.operators import fold, grouped, spatial, world

COLUMNS = "seq long, t_rel long, robot long, x double, y double, z double, hit boolean, r long, g long, b long, layer long, class_id long"


def obs(spark, points, hits=None):
    rows = [(i, i, 0, float(x), float(y), float(z), True if hits is None else hits[i], 1, 2, 3, 0, 0) for i, (x, y, z) in enumerate(points)]
    return spark.createDataFrame(rows, COLUMNS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_hits_are_clamped(spark):
    v = one(fold.folded(obs(spark, [(0.5, 0.5, 0.5)] * 20)))
    assert v.log_odds == K.HIGH and v.obs_count == 20


def test_order_counts_and_rounding_shows(spark):
    hits = [c == "H" for c in "MMMHHHHMM"]
    v = one(fold.folded(obs(spark, [(0.5, 0.5, 0.5)] * 9, hits)))
    assert 0 < v.log_odds < 1e-6
    exact = one(fold.folded_in_runs(obs(spark, [(0.5, 0.5, 0.5)] * 9, hits), bucket=2))
    assert exact.log_odds_100 == 0 and exact.hits == 4


def test_five_hits_then_ten_misses(spark):
    at = [(0.1, 0.1, 0.1)]
    assert world.info(fold.folded(obs(spark, at * 5))).first().voxel_count == 1
    assert world.info(fold.folded(obs(spark, at * 15, [True] * 5 + [False] * 10))).first().voxel_count == 0


def test_seam_points_are_dropped(spark):
    assert fold.folded(obs(spark, [(-1e-9, 0.5, 0.5)])).count() == 0
    assert one(fold.folded(obs(spark, [(-0.25, 0.5, 0.5)]))).cx == -1


def test_empty_map(spark):
    info = world.info(fold.folded(obs(spark, []))).first()
    assert (info.voxel_count, info.chunk_count, info.min_x, info.max_x) == (0, 0, 0, 0)


def test_runs_equal_the_plain_fold(spark):
    rng = np.random.default_rng(1)
    points, hits = rng.integers(0, 3, (400, 3)) / 4, (rng.random(400) < 0.6).tolist()
    got = {tuple(r)[:6]: r.log_odds_100 for r in fold.folded_in_runs(obs(spark, points, hits), bucket=8).collect()}
    want = {}
    for p, h in zip(points, hits, strict=True):
        k = (0, 0, 0, *(int(c * 32) for c in p))
        want[k] = max(-200, min(350, want.get(k, 0) + (85 if h else -70)))
    assert got == want


def test_prune_collapses_a_lone_voxel(spark):
    nodes = world.pruned_all(fold.folded(obs(spark, [(0.1, 0.1, 0.1)])).select(*fold.KEY, "log_odds", "obs_count"))
    assert (one(nodes).depth, one(nodes).ix) == (0, 0)


def test_prune_keeps_what_differs(spark):
    v = fold.folded(obs(spark, [(0.01, 0.01, 0.01), (0.04, 0.01, 0.01)], [True, False]))
    nodes = world.pruned_all(v.select(*fold.KEY, "log_odds", "obs_count"))
    assert sorted(r.depth for r in nodes.collect()) == [5, 5]


def test_pack_and_unpack(spark):
    cf = keys.pack(*(F.lit(v) for v in (255, 128, 64, 1, 5)))
    r = spark.range(1).select(cf.alias("cf")).select("cf", *(c.alias(n) for n, c in keys.unpack(F.col("cf")).items())).first()
    assert (r.r, r.g, r.b, r.layer, r.class_id) == (255, 128, 64, 1, 5) and r.cf < 1 << 32


def test_super_chunk_of_negative_keys(spark):
    r = spark.range(1).select(*(keys.super_chunk(F.lit(v)).alias(n) for n, v in (("a", 5), ("b", 20), ("c", -3)))).first()
    assert tuple(r) == (0, 1, -1)


def test_stride_sampling_returns_all_under_twice_the_budget(spark):
    rows = spark.range(150)
    assert world.strided(rows, 100, ["id"]).count() == 150
    assert [r.id for r in world.strided(spark.range(1000), 100, ["id"]).orderBy("id").collect()] == list(range(0, 1000, 10))


def cloud(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")


def test_nearest_equals_a_scan(spark):
    points = [(i, i % 10, i % 5) for i in range(100)]
    q = spark.createDataFrame([(0, 15.1, 5.1, 0.1), (1, 500.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = spatial.nearest(q, cloud(spark, points), 3).orderBy("query_id", "rank").collect()
    for i, at in ((0, (15.1, 5.1, 0.1)), (1, (500.0, 0.0, 0.0))):
        want = sorted(range(100), key=lambda j: (sum((a - b) ** 2 for a, b in zip(points[j], at, strict=True)), j))[:3]
        assert [r.point_id for r in got if r.query_id == i] == want


def test_nearest_with_fewer_points_than_asked_for(spark):
    assert spatial.nearest(cloud(spark, [(0, 0, 0)]), cloud(spark, [(1, 1, 1), (2, 2, 2)]), 5).count() == 2
    assert spatial.nearest(cloud(spark, [(0, 0, 0)]), cloud(spark, []), 5).count() == 0


def test_radius_is_inclusive(spark):
    got = spatial.within(cloud(spark, [(0, 0, 0)]), cloud(spark, [(0.5, 0, 0), (1, 0, 0), (1.5, 0, 0), (5, 0, 0)]), 1.5)
    assert got.count() == 3


def test_isolated_points_are_outliers(spark):
    rng = np.random.default_rng(0)
    points = [*(rng.random((20, 3)) * 0.05), (9, 9, 9)]
    kept = {r.id for r in spatial.without_outliers(cloud(spark, points), pid="id").collect()}
    assert 20 not in kept and len(kept) >= 15
    assert spatial.without_outliers(cloud(spark, points[:7]), pid="id").count() == 7


def test_planes_need_four_points(spark):
    assert spatial.planes(cloud(spark, [(i, i, 0.02) for i in range(4)])).count() == 1
    assert spatial.planes(cloud(spark, [(i, i, 0.02) for i in range(3)])).count() == 0
    assert spatial.lowest_plane(cloud(spark, [])).first().z is None


@pytest.mark.parametrize(("cells", "boxes"), [([(0, 0, 0, 7)], 1), ([(i, 0, 0, 7) for i in range(4)], 1), ([(0, 0, 0, 7), (1, 0, 0, 8)], 2), ([(x, y, 0, 7) for x in range(2) for y in range(2)], 1), ([(0, 0, 0, 0)], 1)])
def test_cuboids(cells, boxes):
    got = grouped.merge_cuboids(*np.array(cells).T)
    assert len(got) == boxes and got[:, 6].min() >= 1


def test_a_solid_block_keeps_the_scan_s_residue():
    at = np.array([(x, y, z, 7) for x in range(1, 6) for y in range(1, 6) for z in range(1, 6)])
    got = grouped.merge_cuboids(*at.T)
    assert got[:, 3:6].prod(axis=1).sum() == 111


def test_icp_recovers_a_shift():
    c = np.random.default_rng(3).random((300, 3)) * 4
    got = grouped.match(c[:100] + [0.05, 0, 0], c)
    assert abs(got["tx"] + 0.05) < 1e-3 and got["converged"]
    assert grouped.match(c[:5], c) is None and grouped.match(c[:50] + 100, c) is None


def test_motion_of_two_views():
    rng = np.random.default_rng(5)
    p = rng.random((200, 3)) * [4, 4, 4] + [-2, -2, 4]
    t = np.array([0.5, 0.1, 0.0])
    q = p + t
    pairs = np.concatenate([p[:, :2] / p[:, 2:], q[:, :2] / q[:, 2:]], axis=1)
    got = grouped.motion(pairs)
    assert got["inliers"] > 190 and abs(got["direction"] @ (t / np.linalg.norm(t))) > 0.99
    assert grouped.motion(pairs[:10]) is None


def test_subtractive_updates_split_on_conflict():
    root = grouped.Node()
    grouped.update(root, 0.1, 0.1, 0.1, False, 1)
    first = next(n for *_, n in grouped.leaves(root) if n.obs)
    assert first.log_odds == np.float32(-0.7) and first.sdf == -1
    grouped.update(root, 0.1, 0.1, 0.1, True, 5, colour=(9, 9, 9))
    deep = [x for x in grouped.leaves(root) if x[0] == 5]
    assert len(deep) == 1 and deep[0][4].colour == (9, 9, 9)
    assert grouped.update(root, 1.5, 0, 0, True, 3) is None


def test_an_index_answers_as_the_joins_do(spark):
    rows = [(i, float(i % 7), float(i % 5), float(i % 3)) for i in range(60)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    index = spatial.Index(points)
    assert index.count() == 60
    one = index.nearest(points.where("id < 3"), exclude_self=True).orderBy("query_id").collect()
    assert [r["rank"] for r in one] == [1, 1, 1]
    assert index.within(points.where("id = 0"), 1.0).count() == sum((x - 0) ** 2 + y**2 + z**2 <= 1 for _, x, y, z in rows)
