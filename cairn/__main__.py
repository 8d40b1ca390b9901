"""python -m cairn info|view|process PATH: totals or a sample of a stored map, or a map from captured messages."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.operators import world
from cairn.sources import capture, maps
from cairn.world import World


def progress(done: int, began: float, out=sys.stderr) -> None:
    """One line that tells how far a job is."""
    out.write(f"\r{done:,} voxels  {time.monotonic() - began:.1f} s")
    out.flush()


def process(spark: SparkSession, path: str, output: str, name: str) -> int:
    """Fold the world points of captured messages under `path` into a map file under `output`; returns its voxels."""
    began = time.monotonic()
    frames = capture.recorded(spark, path)
    points = capture.world_points(frames)
    obs = points.withColumns({"seq": F.col("sequence") * (1 << 31) + F.col("i"), "t_rel": F.lit(0).cast("long"), "robot": F.lit(0), "hit": F.lit(True), "layer": F.lit(0), "class_id": F.lit(0)})
    exported = world.exported(World.of(obs).voxels).withColumn("map", F.lit(name))
    maps.save_maps(exported, "map", output, name=name, createdAt=time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
    done = exported.count()
    progress(done, began)
    sys.stderr.write("\n")
    return done


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairn", description="Build and inspect stored maps.")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("info", "view"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--files", action="store_true", help="map files instead of a Parquet table")
    sub.choices["view"].add_argument("--max-points", type=int, default=200_000)
    p = sub.add_parser("process")
    p.add_argument("path", help="a folder of captured messages")
    p.add_argument("-o", "--output", required=True, help="the folder of the map file")
    p.add_argument("--name", default="map")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("cairn").getOrCreate()
    if args.command == "process":
        process(spark, args.path, args.output, args.name)
        return 0
    if args.command == "info" and args.files:
        maps.descriptions(spark, args.path).select("name", "created", "voxels").show(1000, truncate=False)
    stored = (World.read if args.files else World.load)(spark, args.path)
    if args.command == "info":
        stored.info().show(1, truncate=False)
    else:
        stored.sample(args.max_points).select("x", "y", "z", "r", "g", "b").show(args.max_points, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
