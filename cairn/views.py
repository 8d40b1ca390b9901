"""Derived inputs: spatial fact tables as projections of the standard tables.

A view is a base table and its columns' expressions, which hold in Spark and in
the checking engine alike, so coordinates agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "obs": (
        "events",
        {
            "seq": "event_id",
            "t_rel": "event_id",
            "robot": "user_id % 64",
            "x": "CAST(user_id % 24 AS DOUBLE) / 8e0",
            "y": "CAST(floor(value / 10e0) AS DOUBLE) / 8e0",
            "z": "CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 8 AS DOUBLE) / 8e0",
            "hit": "event_type <> 'error'",
            "r": "(event_id * 7) % 256",
            "g": "(event_id * 13) % 256",
            "b": "(event_id * 29) % 256",
            "layer": "CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END",
            "class_id": "user_id % 22",
        },
    ),
    "cloud": (
        "embeddings",
        {"vec_id": "vec_id", "label": "label"} | {n: f"CAST(embedding[{i}] AS DOUBLE) * 4e0" for i, n in enumerate("xyz", 1)},
    ),
    "lidar": (
        "lineitem",
        {
            "frame_id": "l_orderkey % 8",
            "pt_idx": "row_number() OVER (PARTITION BY l_orderkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)",
            "x": "l_quantity / 8e0 - 3e0",
            "y": "CAST(l_partkey % 64 AS DOUBLE) / 8e0 - 4e0",
            "z": "CAST(CAST(round(l_tax * 100e0) AS BIGINT) AS DOUBLE) / 16e0",
            "ox": "0e0",
            "oy": "0e0",
            "oz": "1e0",
            "res": "0.0625e0",
        },
    ),
    "rays": (
        "orders",
        {
            "ray_id": "o_orderkey",
            "ox": "0e0",
            "oy": "0e0",
            "oz": "0e0",
            "dx": "CASE o_orderkey % 6 WHEN 0 THEN 1e0 WHEN 1 THEN -1e0 ELSE 0e0 END",
            "dy": "CASE o_orderkey % 6 WHEN 2 THEN 1e0 WHEN 3 THEN -1e0 ELSE 0e0 END",
            "dz": "CASE o_orderkey % 6 WHEN 4 THEN 1e0 WHEN 5 THEN -1e0 ELSE 0e0 END",
            "hit_distance": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice / 10000e0) AS DOUBLE) / 4e0 END",
        },
    ),
    "poses": (
        "supplier",
        {
            "pose_id": "s_suppkey",
            "px": "CAST(s_suppkey % 16 AS DOUBLE) / 2e0",
            "py": "CAST(s_suppkey % 5 AS DOUBLE) / 4e0",
            "pz": "CAST(s_nationkey AS DOUBLE) / 8e0",
        }
        | {f"q{n}": f"CASE s_suppkey % 4 WHEN {k} THEN 1e0 ELSE 0e0 END" for n, k in (("x", 1), ("y", 2), ("z", 3), ("w", 0))},
    ),
    "detections": (
        "part",
        {
            "det_id": "p_partkey",
            "class_id": "p_size % 24",
            "confidence": "CAST(p_partkey % 64 AS DOUBLE) / 64e0",
            "distance": "CAST(floor(p_retailprice - 880e0) AS DOUBLE)",
            "w": "CAST(p_size AS DOUBLE) / 16e0",
            "h": "CAST(p_partkey % 32 AS DOUBLE) / 16e0",
            "bx": "CAST(p_partkey % 8 AS DOUBLE) / 8e0",
            "by0": "CAST(p_partkey % 4 AS DOUBLE) / 4e0",
        },
    ),
    # depth pixels of 8 frames: a depth every pixel of a 16 x 12 raster has, now and then none
    "pixels": (
        "lineitem",
        {
            "frame_id": "l_orderkey % 8",
            "u": "l_partkey % 16",
            "v": "l_suppkey % 12",
            "d": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 4e0 END",
            "r": "l_partkey % 256",
            "g": "l_suppkey % 256",
            "b": "l_linenumber * 32",
        },
    ),
    # optical flow rasters, a vector each pixel
    "flow": (
        "orders",
        {
            "frame_id": "o_custkey % 16",
            "u": "o_orderkey % 64",
            "v": "o_custkey % 48",
            "fx": "CAST(o_orderkey % 33 AS DOUBLE) / 8e0 - 2e0",
            "fy": "CAST(o_custkey % 17 AS DOUBLE) / 8e0 - 1e0",
        },
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A standard table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the tables at `sf_dir`."""
    base, columns = VIEWS[name]
    if name == "cloud":  # arrays count from one elsewhere
        columns = {n: e.replace("embedding[", "element_at(embedding, ").replace("]", ")") for n, e in columns.items()}
    return table(spark, sf_dir, base).selectExpr(*(f"{e} AS {n}" for n, e in columns.items()))


def view_sql(name: str) -> str:
    """The view as a SELECT for the checking engine."""
    base, columns = VIEWS[name]
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {base}"
