"""Capture streams: files of length-prefixed messages, dropped into a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources import wire

FILES = "path string, modificationTime timestamp, length long, content binary"


def capture(spark: SparkSession, path: str, *, per_batch: int = 16) -> DataFrame:
    """A stream of frames and status messages; `per_batch` files at a time hold back what comes too fast."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(path)
    return wire.frames(files)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The frames and status messages of all files under `path`, as a table."""
    return wire.frames(spark.read.format("binaryFile").load(path))


def send(messages: DataFrame, root: str, checkpoint: str, *, once: bool = False):
    """Start the reverse channel: a stream of encoded messages (name, content) goes to files under `root`, a folder that the other side watches; nothing waits for it."""
    from cairn.sources.maps import write_files

    writer = messages.writeStream.foreachBatch(lambda b, _: write_files(b, root, "name")).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def dispatch(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, *, once: bool = False):
    """Start a query that hands each batch's messages to the handler of their kind."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, handle in handlers.items():
            handle(batch.where(F.col("kind") == kind), number)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def world_points(frames: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(`keep`, sequence, i, x, y, z, r, g, b) of the world points of frames, 16 bytes each; colours are zero without the flag."""
    import numpy as np
    import pyarrow as pa

    own = [*keep, "sequence"]
    kinds = dict(frames.dtypes)

    def part(batches):
        for b in batches:
            parts = [p or b"" for p in b.column("points").to_pylist()]
            many = np.array([len(p) // wire.POINT for p in parts], np.int64)
            points = wire.points_of(b"".join(p[: n * wire.POINT] for p, n in zip(parts, many.tolist(), strict=True)), True)
            row = np.repeat(np.arange(len(many)), many)
            flags = b.column("flags").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coloured = (flags & wire.COLOURED)[row] != 0
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at = [pa.array(points[a].astype(np.float64)) for a in "xyz"]
            colours = [pa.array(np.where(coloured, points[c], 0).astype(np.int64)) for c in "rgb"]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in own), pa.array(place), *at, *colours], [*own, "i", "x", "y", "z", "r", "g", "b"])

    return frames.select(*own, "points", "flags").mapInArrow(part, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", " * bool(keep) + "sequence long, i long, x double, y double, z double, r long, g long, b long")
