"""Map files: whole maps (versions 1 and 2), chunk files, and the bitmap coding of an octree.

Reading distributes by file: `binaryFile` brings a file to a task, which turns it
into voxel rows.  A voxel of a file is one hit when it is read.  Writing a map
for exchange goes file by file too, one for each value of a key column; the
native form of a map is Parquet, dealt by chunk.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import constants as K
from cairn.operators.grouped import Node
from cairn.sources.lz4 import compress, decompress

# Magic words and record layouts.
MAP_1, MAP_2, CHUNK = b"BOTMAP01", b"BOTMAP02", b"VXC1"
VOXEL_1 = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4")])
VOXEL_2 = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("cf", "<u4"), ("obs", "<u2"), ("sdf", "<f4")])
LEAF = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("cf", "<u4")])
TREE_LEAF = np.dtype([("log_odds", "<f2"), ("flags", "u1"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("sdf", "<f2")])


class CorruptFile(ValueError):
    """A file that is cut short, of another kind, or doesn't hold what it says."""


def encode_map(meta: dict, voxels: np.ndarray) -> bytes:
    """A version 2 map of records VOXEL_2."""
    text, raw = json.dumps(meta).encode(), voxels.astype(VOXEL_2).tobytes()
    return MAP_2 + struct.pack("<I", len(text)) + text + struct.pack("<II", len(voxels), len(raw)) + compress(raw)


def decode_map(data: bytes) -> tuple[dict, np.ndarray]:
    """The description and the voxels of either version; version 1 has positions only."""
    kind = {MAP_1: VOXEL_1, MAP_2: VOXEL_2}.get(data[:8])
    if kind is None:
        raise CorruptFile("not a map")
    try:
        n = struct.unpack_from("<I", data, 8)[0]
        meta = json.loads(data[12 : 12 + n])
        count, size = struct.unpack_from("<II", data, 12 + n)
    except (struct.error, ValueError) as e:
        raise CorruptFile("a map cut short") from e
    raw = decompress(data[20 + n :], size)
    if raw is None or len(raw) < count * kind.itemsize:
        raise CorruptFile("voxels that can't be unpacked")
    return meta, np.frombuffer(raw, kind, count)


def encode_chunk(key: tuple[int, int, int], version: int, leaves: np.ndarray) -> bytes:
    raw = leaves.astype(LEAF).tobytes()
    return CHUNK + struct.pack("<hhhII", *key, version, len(raw)) + compress(raw)


def decode_chunk(data: bytes, key: tuple[int, int, int] | None = None) -> tuple[tuple[int, int, int], int, np.ndarray]:
    """Key, version and leaves; a key that isn't the one asked for is an error."""
    if len(data) < 18 or data[:4] != CHUNK:
        raise CorruptFile("not a chunk")
    *own, version, size = struct.unpack_from("<hhhII", data, 4)
    if key is not None and tuple(own) != tuple(key):
        raise CorruptFile("a chunk of another key")
    raw = decompress(data[18:], size)
    if raw is None:
        raise CorruptFile("leaves that can't be unpacked")
    return tuple(own), version, np.frombuffer(raw, LEAF)


def chunk_path(key: tuple[int, int, int]) -> str:
    return f"{key[0]}/{key[1]}/{key[2]}.vxchunk"


def encode_tree(node: Node, depth: int = 0) -> bytes:
    """An octree in depth-first order: a bitmap of children, or zero and a leaf; at full depth the leaf alone."""
    leaf = np.array([(node.log_odds, node.layer << 6 | node.class_id & 63, *node.colour, min(float(node.sdf), 65504.0))], TREE_LEAF).tobytes()
    if depth == K.DEPTH:
        return leaf
    if not node.children:
        return b"\0" + leaf
    return bytes((sum(1 << o for o in node.children),)) + b"".join(encode_tree(node.children[o], depth + 1) for o in sorted(node.children))


def decode_tree(data: bytes, at: int = 0, depth: int = 0) -> tuple[Node, int]:
    """The octree, and where its coding ends."""
    node = Node()
    if depth < K.DEPTH:
        if at >= len(data):
            raise CorruptFile("a tree cut short")
        bits, at = data[at], at + 1
        if bits:
            node.children = {}
            for o in range(8):
                if bits >> o & 1:
                    node.children[o], at = decode_tree(data, at, depth + 1)
            return node, at
    if at + TREE_LEAF.itemsize > len(data):
        raise CorruptFile("a tree cut short")
    v = np.frombuffer(data, TREE_LEAF, 1, at)[0]
    node.log_odds, node.colour, node.sdf = np.float32(v["log_odds"]), (int(v["r"]), int(v["g"]), int(v["b"])), np.float32(v["sdf"])
    node.layer, node.class_id = int(v["flags"]) >> 6, int(v["flags"]) & 63
    return node, at + TREE_LEAF.itemsize


_ROWS = "path string, name string, seq long, x double, y double, z double, hit boolean, r long, g long, b long, layer long, class_id long, robot long, t_rel long"


def read_maps(spark: SparkSession, path: str, glob: str = "*.botmap") -> DataFrame:
    """The voxels of map files as observations, a hit each: fold them to get the map. Corrupt files raise."""
    return _read(spark, path, glob, lambda data: (lambda m, v: (m.get("name", ""), v))(*decode_map(data)))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of chunk files under `path` as observations, a hit each."""
    return _read(spark, path, "*.vxchunk", lambda data: ("", decode_chunk(data)[2]))


def _read(spark: SparkSession, path: str, glob: str, decode) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                name, v = decode(data)
                cf = v["cf"].astype(np.int64) if "cf" in (v.dtype.names or ()) else np.full(len(v), K.GREY << 24 | K.GREY << 16 | K.GREY << 8)
                yield pd.DataFrame({"path": p, "name": name, "seq": np.arange(len(v)), **{a: v[a].astype(float) for a in "xyz"}, "hit": True, "r": cf >> 24 & 255, "g": cf >> 16 & 255, "b": cf >> 8 & 255, "layer": 0, "class_id": 0, "robot": 0, "t_rel": 0})

    return files.mapInPandas(part, _ROWS)


def maps_of(exported: DataFrame, key: str, **meta) -> DataFrame:
    """(key, content): a map file's bytes for each value of `key` of an export (x, y, z, cf, obs_count, signed_distance). A map file fits a task by its format."""

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(len(rows), VOXEL_2)
        rows = rows.sort_values(["x", "y", "z"])
        for a in "xyz":
            v[a] = rows[a]
        v["cf"], v["obs"] = rows["cf"], np.minimum(rows["obs_count"], K.MOST_OBSERVATIONS)
        v["sdf"] = rows["signed_distance"]
        return pd.DataFrame({"key": [str(rows[key].iloc[0])], "content": [encode_map({"voxelCount": len(rows), "version": 2, **meta}, v)]})

    return exported.groupBy(key).applyInPandas(encode, "key string, content binary")


def chunks_of(exported: DataFrame, version: int = 0) -> DataFrame:
    """(path, content): a chunk file's bytes for each chunk of an export (cx, cy, cz, x, y, z, cf)."""

    def encode(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(len(rows), LEAF)
        rows = rows.sort_values(["x", "y", "z"])
        for c in ("x", "y", "z", "cf"):
            v[c] = rows[c]
        own = tuple(int(k) for k in key)
        return pd.DataFrame({"path": [chunk_path(own)], "content": [encode_chunk(own, version, v)]})

    return exported.groupBy("cx", "cy", "cz").applyInPandas(encode, "path string, content binary")


def write_files(files: DataFrame, root: str, name: str = "path", suffix: str = "") -> int:
    """Write `files` (a relative path in the column `name`, content) under `root`, a folder that all executors share; returns how many.

    All of them appear when all are written, or none (see `files`).
    """
    from cairn.sources import files as sink

    return sink.written(files.select(F.col(name).alias("path"), "content"), root, suffix)


def save_maps(exported: DataFrame, key: str, root: str, **meta) -> int:
    """A map file under `root` for each value of `key`; returns how many."""
    return write_files(maps_of(exported, key, **meta), root, "key", ".botmap")


def save_chunks(exported: DataFrame, root: str, version: int = 0) -> int:
    """A chunk file under `root` for each chunk; returns how many."""
    return write_files(chunks_of(exported, version), root)


def descriptions(spark: SparkSession, path: str, glob: str = "*.botmap") -> DataFrame:
    """(path, name, created, voxels, meta) of map files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, m.get("name"), m.get("createdAt"), len(v), json.dumps(m)) for p, (m, v) in zip(b["path"], map(decode_map, b["content"]), strict=True)]
            yield pd.DataFrame(rows, columns=["path", "name", "created", "voxels", "meta"]).astype({"created": "string"})

    return files.mapInPandas(part, "path string, name string, created string, voxels long, meta string")


def save(voxels: DataFrame, path: str) -> None:
    """The native form: Parquet, dealt by super-chunk columns, so that boxes prune files."""
    from cairn.functions import keys

    out = voxels.withColumns({f"s{a}": keys.super_chunk(F.col(f"c{a}")) for a in "xyz"})
    out.repartition("sx", "sy", "sz", "cx", "cy", "cz").sortWithinPartitions("sx", "sy", "sz", "cx", "cy", "cz").write.mode("overwrite").partitionBy("sx", "sy", "sz").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
