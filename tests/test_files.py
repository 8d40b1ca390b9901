"""A sink of whole files: all of a write or none."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairn.sources import files


def seen(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)


def test_files_appear_together(spark, tmp_path):
    rows = [(f"a/{i % 3}/{i}", bytes([i]) * i) for i in range(20)] + [(None, b"x"), ("empty", None)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    assert files.written(df, str(tmp_path / "m"), ".bin") == 21
    assert seen(tmp_path / "m") == sorted([f"a/{i % 3}/{i}.bin" for i in range(20)] + ["empty.bin"])
    assert (tmp_path / "m/a/1/4.bin").read_bytes() == b"\4" * 4 and (tmp_path / "m/empty.bin").read_bytes() == b""
    again = spark.createDataFrame([("a/1/4", b"new")], df.schema)
    assert files.written(again, f"file://{tmp_path}/m", ".bin") == 1 and (tmp_path / "m/a/1/4.bin").read_bytes() == b"new"
    assert files.written(again.limit(0), str(tmp_path / "none")) == 0 and seen(tmp_path / "none") == []


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(40, numPartitions=4).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit(b"x")).cast("binary").alias("content"))
    with pytest.raises(PySparkException):
        files.written(bad, str(tmp_path / "m"))
    assert seen(tmp_path / "m") == []
