"""The composed frame step, refinement, rendering by level of detail, map files on disk, and expiry in a live map."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn import constants as K
from cairn.functions import camera
from cairn.operators import detect, fold, frames, grouped, rays, world
from cairn.sources import maps, wire
from cairn.sources.capture import send
from cairn.streaming.fusion import Fusion
from cairn.streaming.live import Refinement, fused, live_map
from cairn.world import World

CAM = (8.0, 8.0, 8.0, 6.0, 16, 12, 0.0, 0.0, 0.0, 0.0, 0.0)
OBS = "seq long, t_rel long, robot int, x double, y double, z double, hit boolean, r long, g long, b long, layer long, class_id long"


def observed(spark, points, layer=0, t=0):
    return spark.createDataFrame([(i, t, 0, *map(float, p), True, 10, 20, 30, layer, 0) for i, p in enumerate(points)], OBS)


def test_cameras_of_matrices():
    cam = K.CAMERAS["robot_dog"]
    m = np.array(camera.intrinsic_matrix(cam), "<f4")
    assert camera.camera_of(m.T.tobytes(), 1280, 720)[:6] == cam[:6]
    assert camera.camera_of(b"short", 1, 1) == camera.camera_of(None, 1, 1) == K.CAMERAS["phone_14"]


def test_depth_model_by_mode(spark):
    pixels = spark.createDataFrame([(0, 4, 4)], "frame_id long, u int, v int")
    fast, fine = (lambda p: frames.flat_depth(p, 1.0)), (lambda p: frames.flat_depth(p, 3.0))
    depth = lambda **k: (got := frames.Pipeline(**k).depth(pixels)) and got.first().d
    assert depth(fast=fast, fine=fine, mode="explore") == depth(fast=fast, fine=fine, mode="hybrid") == 1.0
    assert depth(fast=fast, fine=fine, mode="refine") == 3.0 and depth(fast=fast, mode="refine") == 1.0
    assert depth(fine=fine, mode="explore") is None
    assert frames.flat_depth(pixels).first().d == frames.FLAT == 2.0


def test_a_frame_carves_and_marks_regions(spark):
    pixels = spark.createDataFrame([(f, u, v, 2.0) for f in (0, 1) for u in range(16) for v in range(12)], "frame_id long, u int, v int, d double")
    poses = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 100.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "frame_id long, px double, py double, pz double, qx double, qy double, qz double, qw double")
    boxes = spark.createDataFrame([(0, 7, 3, 0.5, 1.5, 0.0, 0.5, 0.0, 0.5), (1, 8, 3, 5.0, 5.5, 0.0, 0.5, 0.0, 0.5)], "frame_id long, det_id long, class_id long, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    pipeline = frames.Pipeline(fast=lambda p: p, detection_every=2)
    got = pipeline.process(pixels, boxes, poses, CAM)
    each = {r.frame_id: r for r in got["frames"].collect()}
    assert {f: (r.rays, r.hits) for f, r in each.items()} == {0: (12, 12), 1: (12, 12)}
    samples = got["samples"].collect()
    assert sum(r.carved for r in each.values()) == sum(not s.hit for s in samples) and each[0].carved == each[1].carved
    assert min(s.x for s in samples if s.frame_id == 1) > 95
    assert {(r.det_id, r.cx, r.cy, r.cz) for r in got["regions"].collect()} == {(7, 0, 0, 0), (7, 1, 0, 0)}  # every second frame is searched
    assert got["tasks"].count() == 2
    assert frames.Pipeline().process(pixels, boxes, poses, CAM)["samples"].count() == 0


def test_frames_without_new_chunks_are_idle(spark):
    rows = [(1, i, c) for i, c in enumerate([1, 2, 2, 2, 3, 3, 3, 3])]
    got = frames.switched(spark.createDataFrame(rows, "session int, seq int, chunks int"), idle=2).orderBy("seq").collect()
    assert [r.since for r in got] == [0, 0, 1, 2, 0, 1, 2, 3] and [r.idle for r in got] == [False] * 7 + [True]


def test_the_refinement_queue(spark):
    tasks = spark.createDataFrame([(0, 1, 0, 0, 2, 1.0), (1, 2, 0, 0, 1, 0.0), (2, 3, 0, 0, 1, 5.0)], "seq long, cx short, cy short, cz short, priority int, observations double")
    queue = detect.queue(tasks)
    head, rest = detect.dequeued(queue)
    assert [r.cx for r in head.collect()] == [2] and sorted(r.cx for r in rest.collect()) == [1, 3]
    assert [r.cx for r in detect.dequeued(rest)[0].collect()] == [3]
    assert [r.cx for r in detect.pruned_queue(queue, tasks.where("cx = 1")).collect()] == [1]
    head, rest = detect.dequeued(queue.limit(0))
    assert head.count() == rest.count() == 0


def test_refinement_scans_when_its_queue_is_empty(spark):
    voxels = fold.folded(observed(spark, [(0.1, 0.1, 0.1), (1.1, 0.1, 0.1), (1.2, 0.1, 0.1), *((2.1 + i / 10, 0.1, 0.1) for i in range(4))]))
    got = []
    refinement = Refinement(lambda: voxels, lambda head, i: got.append(head.first().cx))
    for i in range(3):
        refinement(None, i)
    assert got == [0, 1, 0]  # the thinnest chunk first; a scan again when none is left
    idle = Refinement(lambda: voxels, lambda head, i: got.append("never"), mode="explore")
    idle(None, 0)
    assert "never" not in got


@pytest.mark.parametrize("subtractive", [False, True])
def test_rendering_by_level_of_detail(spark, subtractive):
    near, far = [(0.1, 0.1, 0.1)] * 3, [(20.1, 0.1, 0.1), (20.1, 0.1, 0.15), (20.9, 0.9, 0.9)]
    voxels = fold.folded(observed(spark, near + far))
    got = sorted((r.cx, r.mx, r.hx, r.cf >> 24) for r in grouped.rendered(voxels, (0.0, 0.0, 0.0), subtractive=subtractive).collect())
    leaf = 1 / 32
    want = [(0, 3.5 * leaf, leaf / 2, 10)]
    if subtractive:  # sixteenths, whatever they hold: two next to each other merge
        want += [(20, 20 + 1.5 / 16, 1 / 32, 128), (20, 20 + 14.5 / 16, 1 / 32, 128)]
    assert [(a, round(b, 9), round(c, 9), d) for a, b, c, d in got] == [(a, round(b, 9), round(c, 9), d) for a, b, c, d in want]
    hidden = grouped.rendered(voxels, planes=[(-1.0, 0.0, 0.0, -5.0)], subtractive=subtractive)
    assert hidden.count() == 0
    every = World(voxels, mode="subtractive" if subtractive else "additive").merged()
    assert every.count() == len(want)
    assert grouped.rendered_far(fold.folded(observed(spark, [(200.0, 0.0, 0.0)])), (0.0, 0.0, 0.0)).count() == 0


def test_coloured_points_carve_up_to_themselves(spark):
    points = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 0.2, 0.0, 0.0)], "id int, x double, y double, z double")
    got = rays.carve_samples(points, (0.0, 0.0, 0.0)).orderBy("id", "s").collect()
    one = [r for r in got if r.id == 1]
    assert (one[0].hit, one[0].x) == (True, 1.0) and [round(r.x, 6) for r in one[1:]] == [round(0.3 + 0.05 * i, 6) for i in range(len(one) - 1)]
    assert len(one) == 1 + int((1.0 - 0.05 - 0.3) / 0.05) and [r.hit for r in got if r.id == 2] == [True]
    assert {r.depth for r in got} == {5}


def test_map_files_on_disk(spark, tmp_path):
    voxels = fold.folded(observed(spark, [(0.1, 0.1, 0.1), (5.1, 0.1, 0.1)])).withColumn("signed_distance", F.lit(-1.0))
    exported = world.exported(voxels).withColumn("part", F.floor("x"))
    assert maps.save_maps(exported, "part", str(tmp_path / "maps"), name="room", createdAt="2024-01-01T00:00:00Z") == 2
    _, v = maps.decode_map((tmp_path / "maps" / "5.botmap").read_bytes())
    assert v["sdf"].tolist() == [-1.0] and v["obs"].tolist() == [1]
    assert [(r.name, r.created, r.voxels) for r in maps.descriptions(spark, str(tmp_path / "maps")).collect()] == [("room", "2024-01-01T00:00:00Z", 1)] * 2
    back = World.read(spark, str(tmp_path / "maps"))
    assert sorted((r.cx, r.ix, r.r, r.g, r.b) for r in back.voxels.collect()) == [(0, 3, 10, 20, 30), (5, 3, 10, 20, 30)]
    leaves = exported.withColumns({f"c{a}": F.floor(a).cast("short") for a in "xyz"})
    assert maps.save_chunks(leaves, str(tmp_path / "chunks")) == 2 and (tmp_path / "chunks" / "5/0/0.vxchunk").exists()
    assert maps.read_chunks(spark, str(tmp_path / "chunks")).count() == 2
    assert world.exported(fold.folded(observed(spark, [(0.1, 0.1, 0.1)]))).first().signed_distance == np.float32(K.UNKNOWN)


def test_messages_of_the_reverse_channel(spark, tmp_path):
    rows = [(f"{i}.bin", bytearray(wire.encode_command(0, 2))) for i in range(3)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "name string, content binary").write.parquet(str(source))
    stream = spark.readStream.schema("name string, content binary").parquet(str(source))
    send(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert [wire.decode_command((tmp_path / "out" / f"{i}.bin").read_bytes()) for i in range(3)] == [(0, 2)] * 3


def test_only_dynamic_voxels_expire_in_a_live_map(spark, tmp_path):
    source = tmp_path / "in"
    first = observed(spark, [(0.1, 0.1, 0.1)], layer=K.DYNAMIC, t=0).unionByName(observed(spark, [(0.5, 0.1, 0.1)], layer=0, t=0))
    second = observed(spark, [(0.9, 0.1, 0.1)], layer=0, t=100)
    for df in (first, second):
        df.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source))
    got = []
    query = live_map(stream, ttl=30).writeStream.outputMode("update").foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()  # timers keep it awake
    query.awaitTermination(1)
    for _ in range(60):
        if any(r.ix == 28 for r in got) or query.awaitTermination(1):
            break
    query.stop()
    last = {r.ix: (round(r.log_odds, 2), r.last_observed) for r in got}
    assert last == {3: (0.0, 0), 16: (0.85, 0), 28: (0.85, 100)}


def test_scan_matches_reach_the_fusion():
    f = Fusion("robot")
    f.feed("encoder", 0.0, np.zeros(3), np.array([0, 0, 0, 1.0]), np.zeros(3))
    f.feed("match", 0.1, np.array([1.0, 0, 0]), np.array([0, 0, 0, 1.0]), np.zeros(3), 0.1)
    pulled = f.position[0]
    assert pulled == pytest.approx(f.trust[3] * 0.8)
    f.feed("scan", 0.2, np.ones(3), np.array([0, 0, 0, 1.0]), np.zeros(3))
    f.feed("match", 0.3, np.ones(3) * 9, np.array([0, 0, 0, 1.0]), np.zeros(3), 0.9)  # too poor to count
    assert f.position[0] == pulled
    rows = pd.DataFrame([(0, "match", 0.0, 1.0, 0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0.0)], columns=["seq", "kind", "t", "px", "py", "pz", "qx", "qy", "qz", "qw", "vx", "vy", "vz", "score"])
    assert fused(rows, "robot")[0].position[0] > 0


def test_process_on_the_command_line(spark, tmp_path, capsys, monkeypatch):
    from cairn import __main__ as cli

    point = struct.pack("<3f4B", 1.1, 2.1, 0.1, 9, 8, 7, 0)
    frame = wire.Frame(5, 1.0, points=point, point_count=1, flags=wire.COLOURED)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(wire.prefixed(wire.encode_frame(frame)) + wire.prefixed(wire.stop_marker()))
    assert cli.main(["process", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--name", "room"]) == 0
    assert cli.main(["info", str(tmp_path / "out"), "--files"]) == 0
    assert cli.main(["view", str(tmp_path / "out"), "--files", "--max-points", "5"]) == 0
    out = capsys.readouterr().out
    assert "room" in out and "|9  |8  |7  |" in out
