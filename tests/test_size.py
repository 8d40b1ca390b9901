"""Queries whose plans or groups must not grow with their tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.plans import queries
from cairn.views import table

SMALL = "/root/testdata/sf0.001"


def agrees(df, name, folder):
    """The rows of `df` are those of the query's SQL over the tables of `folder`."""
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    rel = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    rows = lambda got, names: sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in got)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(rel.fetchall(), rel.columns)


def broadcasts(df):
    """What the plan of `df` sends to all tasks."""
    plan = df._jdf.queryExecution().sparkPlan().toString().split("\n")
    joins = [line for line in plan if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    return [line.strip(" :+-") for line in joins]


# F4


def test_no_detections_are_sent_to_all_tasks(spark):
    """A part file of some MB holds millions of detections, each of many samples: only the priors and a counted raster go to all."""
    joins = broadcasts(queries.detection_project(spark, SMALL))
    assert len(joins) == 2 and all("BuildRight" in j for j in joins)
    assert not any("[det_id" in j for j in joins)


# F2


def test_rasters_beyond_a_message_field_come_back_whole(spark, tmp_path):
    """A frame of 140,000 depths, where a width is 16 bits; other frames of one and of exactly that many."""
    from cairn.sources import wire

    n = {0: 140_000, 1: 1, 2: wire.WIDEST, 3: wire.WIDEST + 1}
    rows = [f"select id % 1000 * 8 + {k} l_orderkey, id % 31 l_partkey, id % 17 l_suppkey, cast(if(id = {many}, 7, 1) as int) l_linenumber, cast(id % 50 as double) l_quantity from range({many + 1})" for k, many in n.items()]
    spark.sql(" union all ".join(rows)).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.wire_roundtrip(spark, str(tmp_path))
    assert {r.sequence: r.width for r in got.collect()} == n
    agrees(got, "wire_roundtrip", tmp_path)


# F3


def test_captured_frames_are_not_joined_again(spark):
    df = queries.capture_chunks(spark, SMALL)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
    agrees(df, "capture_chunks", SMALL)


def test_points_keep_columns_of_their_frames(spark):
    from cairn.sources import capture

    point = b"\0" * 16
    rows = [("a", 1, point * 2, 0), ("b", 1, point, 0), ("c", 2, None, 0)]
    frames = spark.createDataFrame(rows, "name string, sequence long, points binary, flags int")
    got = capture.world_points(frames, keep=("name",)).select("name", "sequence", "i").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 0), ("a", 1, 1), ("b", 1, 0)]
    assert capture.world_points(frames).columns == ["sequence", "i", *"xyzrgb"]


# F1


def around(points, k, cell):
    """(query, point, squared distance) of the k nearest others in the 27 cells about each point."""
    import math

    out = []
    for i, *q in points:
        d = []
        for j, *p in points:
            if i != j and all(abs(math.floor(a / cell) - math.floor(b / cell)) <= 1 for a, b in zip(q, p)):
                x, y, z = (a - b for a, b in zip(q, p))
                d.append((x * x + y * y + z * z, j))
        out += [(i, j, d2) for d2, j in sorted(d)[:k]]
    return sorted(out)


@pytest.mark.parametrize("leaves", [4, 64])
def test_nearest_of_the_cells_about(spark, monkeypatch, leaves):
    """Clusters, a lattice whose points lie on cell borders, many at one place, and isolated points whose nearest lie beyond the cells."""
    import random

    from cairn.operators import kdtree

    for name, value in (("LEAF", 16), ("CHUNK", 20), ("LEAVES", leaves)):
        monkeypatch.setattr(kdtree, name, value)
    r = random.Random(leaves)
    points = [(i, *(r.gauss(3 * (i % 3), 0.02 if i % 2 else 1.5) for _ in range(3))) for i in range(250)]
    points += [(1000 + i, i % 5 / 2, i // 5 % 5 / 2, i // 25 / 2) for i in range(125)] + [(2000 + i, 0.49, 0.51, 0.5) for i in range(30)] + [(3000, 50.0, 0.0, 0.0), (3001, 50.9, 0.0, 0.0), (3002, 51.1, 0.0, 0.0)]
    df = spark.createDataFrame(points, "id long, x double, y double, z double")
    got = kdtree.nearest(df, df, 6, exclude_self=True, cell=0.5).select("query_id", "point_id", "d2").collect()
    assert sorted(map(tuple, got)) == around(points, 6, 0.5)


def test_outliers_need_no_pairs_of_cells(spark, monkeypatch):
    """A dense cell of n points once gave n x n rows to shuffle; now a query's k nearest of a block leave a task."""
    from cairn.operators import spatial

    monkeypatch.setattr(spatial, "_pairs", lambda *a, **k: pytest.fail("all pairs of neighbouring cells"))
    df = spark.range(3000).selectExpr("id", "(id * 7919 % 3000) / 6000D x", "(id * 104729 % 3000) / 6000D y", "0D z")
    means = spatial.neighbour_means(df, pid="id", cell=0.5)
    assert means.count() == 3000


# F5


def test_short_forms_round_as_their_sql(spark, tmp_path):
    """Ties (1.25) go to the even digit, and values a rounding away from them (1.15 and 1.35 lie below and above) to their own side."""
    keys = sorted({n * 125 for n in range(1, 4000)} | {n * 1_000_000_007 for n in range(1, 50)} | set(range(1, 3000)) | {62_500 * n + d for n in range(1, 600) for d in (-1, 0, 1)})
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").where("c_custkey < 2000000000").write.parquet(f"{tmp_path}/customer.parquet")
    agrees(queries.short_forms(spark, str(tmp_path)), "short_forms", tmp_path)


def test_tenths_are_those_of_c(spark):
    from cairn.functions import text

    values = [v / 20 for v in range(20, 40_000)] + [v / 1e6 for v in range(1_050_000, 9_000_000, 50_000)] + [v / 1e3 for v in range(1_050, 1_000_000, 50)] + [999.95, 999.949999, 9e12 + 0.25, 9e12 + 0.75]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", text.tenths(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.v:.1f}" for r in got]


# F6

RAY = "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, hit_distance double"
SHAPE = ("ox", "oy", "oz", "dx", "dy", "dz", "hit_distance")


def marched(part):
    from cairn.operators import rays

    return rays.samples(part).withColumn("seq", F.col("ray_id") * (1 << 31) + F.col("i"))


@pytest.mark.parametrize("seed", range(3))
def test_repeated_rays_carve_as_all_of_them(spark, monkeypatch, seed):
    """Rays that repeat often, seldom or not at all, hits and misses that cancel each other, and rounds of one ray a shape, then two, four, ..."""
    import random

    from cairn.operators import runs

    monkeypatch.setattr(runs, "FIRST", 1)
    monkeypatch.setattr(runs, "MORE", 2)
    r = random.Random(seed)
    rows = []
    for i in range(400):
        d = r.choice([(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.6, 0.8)]) if i % 9 else (r.random(), 0.0, 0.0)
        far = r.choice([0.5, 0.53, 0.56, 0.59, 0.62] if seed else [0.5, 0.75, None]) if i % 7 else r.choice([None, 0.0, 0.25, 1.0])
        rows.append((i, 0.0, 0.0, 0.0, *d, far))
    rays_ = spark.createDataFrame(rows, RAY).repartition(3)
    columns = ["cx", "cy", "cz", "ix", "iy", "iz", "log_odds"]
    got, want = (sorted(map(tuple, df.select(*columns).collect())) for df in (runs.carved(rays_, "ray_id", marched, SHAPE), runs.voxels(rays_, "ray_id", marched)))
    assert got == want


def test_marched_rays_dont_grow_with_repeats(spark, monkeypatch):
    from cairn.operators import runs

    asked, whole = [], runs.voxels
    monkeypatch.setattr(runs, "voxels", lambda obs, *a, **k: asked.append(obs.count()) or whole(obs, *a, **k))
    for n in (2000, 20000):
        lines = spark.range(n).selectExpr("id ray_id", "0D ox", "0D oy", "0D oz", "1D dx", "0D dy", "0D dz", "0.5D + id % 4 / 4D hit_distance")
        runs.carved(lines, "ray_id", marched, SHAPE).count()
    assert asked == [4 * runs.FIRST] * 2


def test_rays_to_be_carved_are_dealt_by_number(spark, monkeypatch):
    """However many tasks the rays come in, a task carves a bounded number of them."""
    from cairn.operators import runs

    monkeypatch.setattr(runs, "CARVED", 50)
    lines = spark.range(1000).selectExpr("id ray_id", "0D ox", "0D oy", "0D oz", "1D dx", "0D dy", "0D dz", "0.25D hit_distance").coalesce(4)
    seen = []

    def carve(part):
        seen.append(part.rdd.getNumPartitions())
        return marched(part)

    assert runs.voxels(lines, "ray_id", carve).agg(F.sum("n")).first()[0] == marched(lines).count()
    assert seen == [20]


# F7


def test_sessions_are_replayed_in_batches(spark):
    """Sessions of many batches come out as in one piece, and no task holds one."""
    import pandas as pd

    from cairn.streaming.live import fused, replay

    rows = [(None if i % 5 == 4 else i % 5, i * 7 % 997, ("video", "imu", "encoder")[i % 3], i / 64, i % 11 / 10, 0.0, 0.0, 0.0, 0.0, 0.6, 0.8, 0.5, 0.0, 0.0) for i in range(500)]
    names = ["session", "seq", "kind", "t", "px", "py", "pz", "qx", "qy", "qz", "qw", "vx", "vy", "vz"]
    df = spark.createDataFrame(rows, "session long, seq long, kind string, " + ", ".join(f"{n} double" for n in names[3:]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = replay(df)
        assert "FlatMapGroups" not in out._jdf.queryExecution().sparkPlan().toString()
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for key in (0, 1, 2, 3, None):
        part = pd.DataFrame([r for r in rows if r[0] == key], columns=names)
        want += [(key, *(v.item() if hasattr(v, "item") else v for v in r)) for r in fused(part, "robot")[1]]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(want, key=order)


# F8 and F9


def test_a_task_holds_a_bounded_piece_of_its_updates(spark):
    """1,200,000 updates of one task are composed in pieces of 524,288 or a batch more, which the fold puts together."""
    from cairn.operators import runs

    rows = spark.range(0, 1_200_000, 1, 1).selectExpr("id seq", "0.5D + id % 3 x", "0.5D y", "0.5D z", "id % 5 < 2 hit")
    pieces = runs.runs(rows)[0].groupBy("block").agg(F.sum("n").alias("n")).collect()
    assert len(pieces) == 3 and max(p.n for p in pieces) <= (1 << 19) + 10_000
    assert sorted(r.n for r in runs.voxels(rows).select("n").collect()) == [400_000] * 3
