"""Nearest points by a k-d split against all pairs."""

import random

import numpy as np
import pytest

from cairn.operators import kdtree


def squared(q, p):
    x, y, z = (a - b for a, b in zip(q, p))
    return x * x + y * y + z * z  # in this order: sum() would compensate


def brute(queries, points, k, exclude_self=False):
    out = []
    for i, *q in queries:
        d = sorted((squared(q, p), j) for j, *p in points if not (exclude_self and i == j))
        out += [(i, r + 1, j, d2) for r, (d2, j) in enumerate(d[:k])]
    return sorted(out)


def table(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"id {kind}, x double, y double, z double")


def got(*args, **more):
    return sorted(tuple(r) for r in kdtree.nearest(*args, **more).select("query_id", "rank", "point_id", "d2").collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_all_pairs_at_many_leaves_blocks_and_chunks(spark, monkeypatch, seed):
    """Dense clusters, a lattice with ties and many points at one place; leaves of 16 points, chunks of 20 queries, at most 8 leaves in one of the runs."""
    monkeypatch.setattr(kdtree, "LEAF", 16)
    monkeypatch.setattr(kdtree, "CHUNK", 20)
    monkeypatch.setattr(kdtree, "LEAVES", 8 if seed else 64)
    r = random.Random(seed)
    points = [(i, *(r.gauss(5 * (i % 3), 0.01 if i % 2 else 2) for _ in range(3))) for i in range(300)]
    points += [(1000 + i, i % 5, i // 5 % 5, i // 25) for i in range(125)] + [(2000 + i, 1.0, 1.0, 1.0) for i in range(200)]
    points = [(i, float(x), float(y), float(z)) for i, x, y, z in points]
    df = table(spark, points)
    assert got(df, df, 3, exclude_self=True) == brute(points, points, 3, True)
    queries = [(-i, r.uniform(-9, 19), r.uniform(-9, 19), r.uniform(-9, 19)) for i in range(60)]
    assert got(table(spark, queries), df, 7) == brute(queries, points, 7)


def test_no_group_grows_with_a_dense_place(spark):
    """Points within a millimetre of each other are cut as those apart are."""
    r = np.random.default_rng(3)
    sample = np.concatenate([r.normal(0, 1e-4, (20_000, 3)), r.uniform(-100, 100, (200, 3))])
    tree = kdtree.Tree(sample, 16)
    sizes = np.bincount(tree.leaf(sample), minlength=16)
    assert sizes.max() < 2 * len(sample) / 16
    row, leaf = tree.within(sample[:500], np.full(500, 1e-10))
    assert len(row) < 1000 and (np.bincount(row, minlength=500) >= 1).all()


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    points = table(spark, [(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, nan, 0.0, 0.0), (4, inf, 0.0, 0.0), (5, -0.0, 0.0, 0.0)])
    assert got(table(spark, [(1, 3.0, 4.0, 0.0), (9, None, 1.0, 1.0)]), points, 5) == [(1, 1, 1, 25.0), (1, 2, 5, 25.0)]
    assert got(points, points.limit(0), 2) == [] and got(points.limit(0), points, 2) == []
    names = table(spark, [("b", 0.0, 0.0, 0.0), ("a", 0.0, 0.0, 0.0), ("é", 1.0, 0.0, 0.0)], "string")
    assert got(names, names, 1, exclude_self=True) == [("a", 1, "b", 0.0), ("b", 1, "a", 0.0), ("é", 1, "a", 1.0)]
