"""Helpers that the operators share: table access, shared-folder checkpoints, folds."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts handed to a vectorised kernel at once; bounds a Python worker's memory.
SLICE_BYTES = 4 << 20
#: Bytes that Spark hands to a Python worker at once, where the session sets no bound of its own.
BATCH_BYTES, SPARK_BATCH = 16 << 20, "67108864b"
#: Rows of a few numbers each that a join may broadcast.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data set at `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where none is set and the executors are this process, as in tests."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that a lost executor costs no recomputation of its lineage."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcasting if it has no more than `rows` rows; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo `k`; null ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in row ranges whose `column` holds about `limit` bytes at most (a longer single row stands alone)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [n]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers of BATCH_BYTES at most: rows alone are no bound where texts are long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == SPARK_BATCH:
        spark.conf.set(name, f"{BATCH_BYTES}b")


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's function that gives free heap pages back, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def _release() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(part):
    """`part`, a function of a task's batches, that gives a reused Python worker's free memory back when the task ends."""

    @functools.wraps(part)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from part(batches)
        finally:
            _release()

    return run


def tidy_group(work):
    """`work`, a function of a large group's key and table, that gives free memory back after each."""

    @functools.wraps(work)
    def run(key: tuple, t: pa.Table) -> pa.Table:
        try:
            return work(key, t)
        finally:
            _release()

    return run


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` bears."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def appended(df: DataFrame, text: str, new: dict[str, str], work) -> DataFrame:
    """`df` with the columns `new` (name -> type) that work(record batch) returns as Arrow arrays.

    A column of `df` that bears one of the new names (in any case) is replaced.
    Batches are cut so that `text` takes about SLICE_BYTES in each.
    """
    bounded_batches(df.sparkSession)
    taken = {n.lower() for n in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*kept, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in new.items())])
    names = [f.name for f in kept]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text):
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *work(b)], [*names, *new])

    return df.mapInArrow(tidy(part), schema)


def repeated(df: DataFrame, doc_id: str, text: str, decided: DataFrame) -> DataFrame:
    """Each document of `df` as often as `decided` (doc_id, tie, copies) says, tie being its text's MD5 digest.

    A document is an id and a text: of rows that repeat both, one counts, with
    the copies of all.  Documents that `decided` lacks, or gives no copies, go.
    """
    each = decided.groupBy("doc_id", "tie").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    d = each.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "copies").hint("shuffle_hash")
    row = df.select(F.struct("*").alias("row"), F.col(doc_id).alias("_d"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_t"))  # clashes with no name
    if row.groupBy("_d", "_t").count().where("count > 1").limit(1).count():
        row = row.groupBy("_d", "_t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    out = row.join(d, row["_d"].eqNullSafe(d["_id"]) & (row["_t"] == d["_tie"]))
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
