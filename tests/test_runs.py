"""Runs of updates composed before the shuffle, and Morton keys, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import constants as K
from cairn.functions import morton
from cairn.operators import fold, rays, runs


def plain(start, hits):
    x = np.float32(start)
    for h in hits:
        x = np.minimum(runs.HIGH, np.maximum(runs.LOW, np.float32(x + (runs.HIT if h else runs.MISS))))
    return x


def test_runs_take_every_value_where_single_updates_do():
    r = random.Random(2)
    for _ in range(200):
        key, hit = [], []
        for i in range(r.randint(1, 5)):
            n, p = r.choice([1, 3, 20, 64, 65, 300]), r.choice([0.1, 0.3, 0.45, 0.5, 0.9])
            key += [10 * i] * n
            hit += [r.random() < p for _ in range(n)]
        starts, lo, hi, steps = runs.composed(np.array(key, np.int64), np.array(hit))
        for s, e, a, b, t in zip(starts, [*starts[1:], len(key)], lo, hi, steps, strict=True):
            assert plain(K.LOW, hit[s:e]) == a and plain(K.HIGH, hit[s:e]) == b
            assert (t == "") == (a == b)
    assert all(len(x) == 0 for x in runs.composed(np.zeros(0, np.int64), np.zeros(0, bool)))


OBS = "seq long, t_rel long, robot long, x double, y double, z double, hit boolean, r long, g long, b long, layer int, class_id long"


def observations(n, r):
    """A hot voxel with a third of all rows, others at random, points outside every chunk, null sequence numbers apart."""
    out = []
    for seq in range(n):
        at = (0.5, 0.5, 0.5) if seq % 3 == 0 else tuple(r.choice([-1.01, -0.26, 0.0, 2.99, 40000.0]) for _ in range(3))
        out.append((seq, seq // 2, r.randint(-2, 70), *at, r.random() < 0.45, seq % 256, 1, None if seq % 7 == 0 else 2, seq % 3, seq % 22))
    return out


def expected(rows):
    state = {}
    for seq, t, robot, x, y, z, hit, r, g, b, layer, class_id in sorted(rows):
        c = [min(32767, max(-32768, int(np.floor(v)))) for v in (x, y, z)]
        local = [np.float32(v) - np.float32(k) for v, k in zip((x, y, z), c)]
        if not all(0 <= v < 1 for v in local):
            continue
        key = (*c, *(int(v * 32) for v in local))
        v = state.setdefault(key, [np.float32(0), 0, 0])
        v[0] = plain(v[0], [hit])
        v[1], v[2] = min(65535, v[1] + hit), v[2] | (1 << robot if 0 <= robot < 64 else 0)
        v[3:] = [t, r, g, b, layer, class_id]
    mask = lambda m: m - (1 << 64) if m >> 63 else m
    return {k: (float(v[0]), v[1], mask(v[2]), *v[3:]) for k, v in state.items()}


def got(df):
    return {tuple(r[c] for c in fold.KEY): tuple(r[c] for c in ("log_odds", "obs_count", "observer_mask", "last_observed", "r", "g", "b", "layer", "class_id")) for r in df.collect()}


@pytest.mark.parametrize("shuffled", [False, True])
def test_fold_equals_one_update_after_another(spark, monkeypatch, shuffled):
    monkeypatch.setattr(runs, "FAN", 2)
    r = random.Random(4)
    rows = observations(3000, r)
    df = spark.createDataFrame(sorted(rows, key=lambda x: r.random()) if shuffled else rows, OBS)
    df = df.repartition(7) if shuffled else df.coalesce(3)
    assert runs.spans(df, "seq")[0] != shuffled
    assert got(fold.folded(df)) == expected(rows)


def test_no_row_a_sample_crosses_the_network(spark):
    """Twenty thousand rays through the same voxels: what leaves the tasks is a row a voxel and task, whatever the number of rays."""
    sizes = []
    for n in (2000, 20000):
        lines = spark.range(n).select(F.col("id").alias("ray_id"), *(F.lit(0.0).alias(f"o{a}") for a in "xyz"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"), F.lit(2.0).alias("hit_distance"))
        carve = lambda part: rays.samples(part).withColumn("seq", F.col("ray_id") * (1 << 31) + F.col("i"))
        rows, _ = runs.runs(carve(lines.repartitionByRange(4, "ray_id")))
        sizes.append((rows.count(), rows.where("lo <> hi").count()))
        whole = runs.voxels(lines, "ray_id", carve).agg(F.count(F.lit(1)), F.sum("n")).first()
        assert whole[1] == n * rays.samples(lines.limit(1)).count()
    assert sizes[0] == sizes[1] == (4 * whole[0], 0)


def test_odd_inputs(spark):
    assert fold.folded(spark.createDataFrame([], OBS)).count() == 0
    rows = [(None, 1, 0, 0.5, 0.5, 0.5, True, 1, 1, 1, 0, 0), (5, 2, 0, 0.5, 0.5, 0.5, None, 2, 2, 2, 0, 0), (6, 3, 0, None, 0.5, 0.5, True, 2, 2, 2, 0, 0), (7, 3, 0, float("nan"), 0.5, 0.5, True, 2, 2, 2, 0, 0)]
    (v,) = fold.folded(spark.createDataFrame(rows, OBS)).collect()
    assert (v.log_odds, v.obs_count, v.r) == (float(plain(0, [True, False])), 1, 2)


def test_ranges_that_meet_are_an_error(spark):
    from pyspark.errors import PySparkException

    at = dict.fromkeys("xyz", 0.5)
    rows, last = runs.runs(spark.createDataFrame([(s, True, *at.values()) for s in (1, 5, 3, 7)] * 1, "seq long, hit boolean, x double, y double, z double").coalesce(1).repartition(1))
    two = rows.unionByName(rows.withColumn("first", F.col("first") + 1))
    with pytest.raises(PySparkException):
        runs._met(two, last, F.lit(0), F.lit(0)).collect()


# --- Morton keys ------------------------------------------------------------


def code(c, i):
    u = [(a + 32768) << 5 | b for a, b in zip(c, i)]
    return sum((u[k] >> b & 1) << 3 * b + k for b in range(21) for k in range(3))


def test_keys_and_back(spark):
    r = random.Random(1)
    rows = [tuple(r.randint(-32768, 32767) for _ in range(3)) + tuple(r.randint(0, 31) for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "cx short, cy short, cz short, ix short, iy short, iz short").withColumn("key", morton.key())
    keys = [g.key for g in df.collect()]
    assert keys == [code(p[:3], p[3:]) for p in rows]
    assert [tuple(x) for x in morton.located(df.select("key")).select(*fold.KEY).collect()] == rows
    back = morton.corners(np.array(keys))
    assert list(zip(*(back[c].tolist() for c in fold.KEY))) == rows
    points = np.array([[c + (i + 0.5) / 32 for c, i in zip(p[:3], p[3:])] for p in rows])
    same, inside = morton.keys(*points.T)
    far = np.abs(points).max(axis=1) > 16000  # single precision has no leaf centres out there
    assert (same[inside & ~far] == np.array(keys)[inside & ~far]).all() and inside[~far].all()


@pytest.mark.parametrize("most", [1, 8, 64, 300])
def test_ranges_hold_their_region(most):
    r = np.random.default_rng(1)
    regions = (morton.box((0, 1, 0), (3.3, 5.2, 1)), morton.sphere((1, 3, 0.5), 1.5), morton.frustum([(1.0, 0, 0, -0.5), (0, -1.0, 0, 6.0), (0.7, 0.7, 0, -1.0)]))
    for relation in regions:
        parts = morton.ranges(relation, most)
        assert len(parts) <= most and all(a <= z for a, z in parts) and all(p[1] + 1 < q[0] for p, q in zip(parts, parts[1:]))
        points = r.uniform(-2, 8, (2000, 3))
        keys, _ = morton.keys(*points.T)
        held = np.array([any(a <= k <= z for a, z in parts) for k in keys.tolist()])
        inside = np.array([relation(p, p) >= 0 for p in points])
        assert not (inside & ~held).any()
        if most == 300:
            assert held.sum() < 2.5 * inside.sum()
