"""Codecs by their bytes, and streams against batch replays."""

import struct

import numpy as np
import pandas as pd
import pytest

from cairn.operators import fold, grouped
from cairn.sources import lz4, maps, wire
from cairn.streaming.fusion import Fusion, slerp
from cairn.streaming.live import fused, live_map
from cairn.views import view
from conftest import DATA


def test_frame_layout_and_round_trip():
    f = wire.Frame(42, 1234.567, width=640, height=480, image=b"12345", depth_width=4, depth_height=2, depth=bytes(16), flags=1)
    data = wire.encode_frame(f)
    assert len(data) == 146 + 5 + 16 and data[:4] == b"VXSF" and struct.unpack_from("<I", data, 4)[0] == 42
    assert wire.decode_frame(data) == f
    assert wire.decode_frame(data[:-1]) is None and wire.decode_frame(b"abcd") is None


def test_large_depth_is_compressed():
    f = wire.Frame(1, 0.0, depth_width=256, depth_height=192, depth=b"\x42" * (256 * 192 * 2))
    data = wire.encode_frame(f)
    assert len(data) < 5000 and wire.decode_frame(data).depth == f.depth


def test_other_messages():
    assert wire.decode_status(wire.encode_status((1, 0, 2, 88, 1, 2))) == (1, 0, 2, 88, 1, 2)
    assert wire.decode_command(wire.encode_command(0, 2)) == (0, 2) and wire.decode_command(wire.encode_command(9, 2)) is None
    assert wire.decode_snapshot(wire.encode_snapshot(3, 4, b"xyz")) == (3, 4, b"xyz")
    v = np.array([(1, 2, 3, 4)], dtype=[("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("cf", "<u4")])
    assert wire.decode_preview(wire.encode_preview(v)).tolist() == v.tolist() and wire.decode_preview(b"VXPV\1\0\0\0") is None


def test_messages_stop_at_what_is_unknown():
    buffer = wire.prefixed(wire.encode_status((1, 2, 3, 4, 5, 6))) + wire.prefixed(wire.stop_marker())
    assert [k for k, _, _ in wire.messages(buffer + wire.prefixed(b"????") + buffer)] == ["status", "frame"]
    assert list(wire.messages(buffer[:10])) == []


def test_denormal_depths_turn_to_zero():
    raw = np.array([0x0001, 0x3C00, 0x8001], "<u2").tobytes()
    got = wire.depth_of(raw, 3, 1)[0]
    assert got.tolist() == [0, 1, 0] and np.signbit(got[2])


def test_lz4_container():
    for data in (b"", b"abc", b"a" * 1000, np.random.default_rng(0).bytes(500)):
        assert lz4.decompress(lz4.compress(data), len(data)) == data
    assert lz4.decompress(b"garbage", 1000) is None


def test_map_and_chunk_files(spark, tmp_path):
    v = np.zeros(2, maps.VOXEL_2)
    v["x"], v["cf"] = [0.5, 1.5], 0x01020300
    data = maps.encode_map({"name": "m"}, v)
    assert maps.decode_map(data)[1].tolist() == v.tolist()
    for bad in (b"nothing", data[:20], data[:-20]):
        with pytest.raises(maps.CorruptFile):
            maps.decode_map(bad)
    (tmp_path / "a.botmap").write_bytes(data)
    rows = maps.read_maps(spark, str(tmp_path)).orderBy("x").collect()
    assert [(r.x, r.r, r.hit) for r in rows] == [(0.5, 1, True), (1.5, 1, True)]
    leaf = np.zeros(1, maps.LEAF)
    chunk = maps.encode_chunk((1, 2, -3), 42, leaf)
    assert maps.decode_chunk(chunk, (1, 2, -3))[1] == 42
    with pytest.raises(maps.CorruptFile):
        maps.decode_chunk(chunk, (1, 2, 3))


def test_tree_coding():
    root = grouped.Node()
    for p in ((0.1, 0.2, 0.3), (0.9, 0.9, 0.9)):
        grouped.update(root, *p, True, 5, colour=(1, 2, 3))
    got, end = maps.decode_tree(data := maps.encode_tree(root))
    assert end == len(data)
    shape = lambda n: [(d, x, y, z, n.colour) for d, x, y, z, n in grouped.leaves(n)]
    assert shape(got) == shape(root)


def test_live_map_equals_the_batch_fold(spark, tmp_path):
    obs = view(spark, str(DATA / "sf0.001"), "obs")
    source = tmp_path / "in"
    for k in range(2):
        obs.where(f"seq div 500 = {k}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = []
    query = live_map(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {tuple(r)[:6]: (r.log_odds, r.obs_count) for r in got}
    want = {tuple(r)[:6]: (r.log_odds, r.obs_count) for r in fold.folded(obs).select(*fold.KEY, "log_odds", "obs_count").collect()}
    assert last == want


def sample(seq, kind, p=(0, 0, 0), q=(0, 0, 0, 1), v=(0, 0, 0)):
    return (seq, kind, seq / 10, *map(float, p), *map(float, q), *map(float, v))


def test_fusion():
    names = ["seq", "kind", "t", "px", "py", "pz", "qx", "qy", "qz", "qw", "vx", "vy", "vz"]
    rows = [sample(0, "encoder", (1, 0, 0)), sample(1, "encoder", (2, 0, 0), v=(1, 0, 0)), sample(2, "imu", q=(0, 0, 1, 0)), sample(3, "video", (0.5, 0, 0))]
    f, out = fused(pd.DataFrame(rows, columns=names), "robot")
    assert out[0][1] == "initializing" and out[1][2] > 1 and f.scale > 0
    half = slerp(np.array([0, 0, 0, 1.0]), np.array([0, 0, 1.0, 0]), 0.5)
    assert np.allclose(half, [0, 0, 2**-0.5, 2**-0.5])


def test_scale_gate():
    f = Fusion()
    for ratio in (2.0, 2.1, 9.0, 1.9):
        f.add_ratio(ratio, 1.0)
    assert f.ratios == [2.0, 2.1, 1.9] and f.scale == 2.0


def test_capture_dispatches_messages_by_kind(spark, tmp_path):
    from cairn.sources.capture import capture, dispatch, world_points

    source = tmp_path / "drop"
    source.mkdir()
    point = struct.pack("<3f4B", 1, 2, 3, 9, 8, 7, 0)
    frame = wire.Frame(5, 1.0, points=point, point_count=1, flags=wire.COLOURED)
    (source / "a.bin").write_bytes(wire.prefixed(wire.encode_status((1, 1, 0, 50, 0, 2))) + wire.prefixed(wire.encode_frame(frame)) + wire.prefixed(wire.stop_marker()) + wire.prefixed(wire.encode_frame(frame)))
    got = {"frame": [], "status": []}
    handlers = {"frame": lambda b, i: got["frame"].extend(world_points(b).collect()), "status": lambda b, i: got["status"].extend(b.collect())}
    dispatch(capture(spark, str(source)), handlers, str(tmp_path / "cp"), once=True).awaitTermination()
    assert [tuple(r) for r in got["frame"]] == [(5, 0, 1.0, 2.0, 3.0, 9, 8, 7)] and len(got["status"]) == 1
