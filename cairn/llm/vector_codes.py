"""Vector code compression: integer product codebooks, learnt by tree aggregation over columnar blocks.

A component x becomes the integer floor(SCALE * x).  Vectors lie in blocks of
BLOCK rows, one NumPy array a block with a line for each dimension, kept in the
shared folder as the smallest integers that hold them.  A round sends each
block past the codebooks: squared distances to all entries of a part
accumulate dimension by dimension over TILE vectors at a time, every vector
takes its nearest entry, and np.add.at gathers sums and counts, which merge
through a reduction tree.  Integers make sums independent of their order, so
lost executors, retries and other partitionings change no bit.

Sizes are exact at any magnitude: 32-bit integers where no distance can exceed
them, 64-bit ones where that holds, Python's own beyond.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, checkpointed, small, tidy, unused

#: Integers per unit, parts of a vector, entries of a codebook, rounds of learning.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of a block, and vectors whose distances to all entries are held at once (TILE x ENTRIES integers stay in a core's cache).
BLOCK, TILE = 4096, 128
#: Depth of the reduction tree, and shares of a label where labels are too many to broadcast.
DEPTH, SALTS = 3, 16
LARGEST = (1 << 63) - 1


def whole(x: float) -> int:
    """floor(SCALE * x), also where SCALE * x is beyond a double."""
    return math.floor(SCALE * x) if abs(x) < 1e300 else int(x) * SCALE


def integers(values: np.ndarray) -> np.ndarray:
    """`values` as whole numbers of the smallest type that holds them; as Python's integers beyond 64 bits."""
    top = float(np.abs(values).max(initial=0.0)) * SCALE
    if top < 1 << 62:
        return np.floor(values * SCALE).astype(np.int16 if top < 1 << 14 else np.int32 if top < 1 << 30 else np.int64)
    return np.array([whole(x) for x in values.ravel().tolist()], object).reshape(values.shape)


def packed(block: np.ndarray) -> bytes:
    return block.dumps() if block.dtype == object else block.dtype.char.encode() + block.tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    """A block with a line for each of `width` dimensions."""
    return pickle.loads(data) if data[:1] == b"\x80" else np.frombuffer(data, data[:1].decode(), offset=1).reshape(width, -1)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of `part` its nearest entry (ties: the first) and the squared distance; `entries` has a column each."""
    n, reach = part.shape[1], int(np.abs(part).max(initial=0)) + int(np.abs(entries).max(initial=0)) if part.size else 0
    most = part.shape[0] * reach * reach
    kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object
    part, entries = part.astype(kind, copy=False), entries.astype(kind, copy=False)
    which, far = np.zeros(n, np.int64), np.zeros(n, object if kind is object else np.int64)
    for a in range(0, n, TILE):
        tile = part[:, a : a + TILE, None]
        total = np.zeros((tile.shape[1], entries.shape[1]), kind)
        step = np.empty_like(total)
        for d in range(part.shape[0]):
            np.subtract(tile[d], entries[d], out=step)
            np.multiply(step, step, out=step)
            np.add(total, step, out=total)
        best = total.argmin(axis=1)
        which[a : a + TILE], far[a : a + TILE] = best, total[np.arange(len(best)), best]
    return which, far


@dataclass(frozen=True)
class Codebooks:
    """Learnt codebooks: an array (part, position in the part, entry) of integers, for vectors padded to `width` dimensions."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[1]

    def digest(self) -> str:
        """SHA-256, in hex, of all integers in decimal by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for x in self.entries.transpose(0, 2, 1).ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for: the middles of its entries' integers."""
        return [(int(x) + 0.5) / SCALE for p, part in enumerate(self.entries) for x in part[:, int(code[2 * p : 2 * p + 2], 16)]]


def kept(df: DataFrame, vector: str) -> DataFrame:
    """The rows of `df` whose vector is given and has only finite components."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(v.isNotNull() & sound)


def blocks(df: DataFrame, vec_id: str, vector: str, label: str, width: int) -> DataFrame:
    """The rows of `df` in columnar blocks: ids, labels and data, whose vectors are padded with zeros to `width` dimensions."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kinds = dict(rows.dtypes)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, BLOCK):
                b = whole_batch.slice(a, BLOCK)
                at = b.column("v").offsets.to_numpy().astype(np.int64)
                values, sizes = b.column("v").values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], np.diff(at)
                dense = np.zeros((b.num_rows, width))
                dense[np.repeat(np.arange(b.num_rows), sizes), np.arange(len(values)) - np.repeat(at[:-1] - at[0], sizes)] = values
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(n)) for n in ("id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([packed(np.ascontiguousarray(integers(dense).T))], pa.binary())], ["ids", "labels", "data"])

    return rows.mapInArrow(tidy(part), f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, data binary")


def _gathered(entries: np.ndarray, total: tuple, rows: Iterable[bytes], width: int) -> tuple:
    """`total` with the sums and counts of the vectors of `rows` by part and nearest entry."""
    sums, counts = total
    parts, w, n = entries.shape
    if sums is None:
        sums, counts = np.zeros((parts, n, w), np.int64), np.zeros((parts, n), np.int64)
    for data in rows:
        block = unpacked(data, width).reshape(parts, w, -1)
        large = block.dtype == object or int(np.abs(block).max(initial=0)) > LARGEST >> 40  # else sums over 2^40 vectors stay within 64 bits
        if large and sums.dtype != object:
            sums = sums.astype(object)
        for p in range(parts):
            which, _ = nearest(block[p], entries[p])
            np.add.at(sums[p], which, block[p].T.astype(sums.dtype))
            np.add.at(counts[p], which, 1)
    return sums, counts


def _merged(a: tuple, b: tuple) -> tuple:
    return b if a[0] is None else a if b[0] is None else (a[0] + b[0], a[1] + b[1])


def learn(columnar: DataFrame, entries: np.ndarray, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after `rounds` passes over `columnar` (as `blocks` gives it), from the initial `entries`.

    The driver holds the codebooks and what leaves the reduction tree, sizes
    that only the width of a vector and the number of entries settle.
    """
    spark = columnar.sparkSession
    data = columnar.select("data").rdd.map(lambda r: bytes(r[0]))
    width = entries.shape[0] * entries.shape[1]
    for _ in range(rounds if entries.shape[2] else 0):
        sent = spark.sparkContext.broadcast(entries)
        sums, counts = data.treeAggregate((None, None), lambda total, row: _gathered(sent.value, total, [row], width), _merged, DEPTH)
        used = counts > 0
        means = sums // np.maximum(counts, 1)[:, :, None]
        entries = np.where(used[:, :, None], means, entries.transpose(0, 2, 1).astype(means.dtype)).transpose(0, 2, 1)
        sent.unpersist()
    return Codebooks(entries)


def encode(columnar: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every vector of `columnar`; an error beyond a long counts as the largest one."""
    spark, entries = columnar.sparkSession, books.entries
    sent = spark.sparkContext.broadcast(entries)
    kinds = {f.name: f.dataType.elementType.simpleString() for f in columnar.schema.fields if f.name != "data"}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, labels = (b.column(n).slice(k, 1).flatten() for n in ("ids", "labels"))
                parts, w, _ = sent.value.shape
                block = unpacked(b.column("data")[k].as_py(), parts * w).reshape(parts, w, len(ids))
                found = [nearest(block[p], sent.value[p]) for p in range(parts)]
                codes = np.stack([which for which, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                error = [min(sum(e), LARGEST) for e in zip(*(far.tolist() for _, far in found), strict=True)]
                size = 2 * parts
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([codes[i : i + size] for i in range(0, len(codes), size)], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return columnar.mapInArrow(tidy(part), f"vec_id {kinds['ids']}, label {kinds['labels']}, code string, error long")


def compressed(df: DataFrame, vec_id: str, vector: str, label: str, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Each kept row's (vec_id, label, code, error), and the codebooks.

    Rows without a vector, or with a null or non-finite component, are left
    out.  Codebooks start as the parts of the `entries` (256 at most) least
    ids; null ids come last and equal ids are ordered by vector, so that reruns
    agree; fewer rows give fewer entries.  Repeated rows count as often as they
    occur.  Vectors of different or odd lengths count as padded with zeros to
    the longest, and that to a multiple of `parts`.  No kept row: no row.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code's digits hold up to 256 entries")
    rows = kept(df, vector)
    longest = rows.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 1
    width = -(-longest // parts) * parts
    first = rows.select(F.col(vec_id).alias("i"), F.col(vector).cast("array<double>").alias("v")).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    start = np.zeros((len(first), width))
    for k, r in enumerate(first):
        start[k, : len(r["v"])] = r["v"]
    start = integers(start)
    columnar = checkpointed(blocks(rows, vec_id, vector, label, width))
    if start.dtype != object:
        start = start.astype(np.int64)
    books = learn(columnar, start.T.reshape(parts, width // parts, len(first)), rounds)
    return encode(columnar, books), books


def label_errors(coded: DataFrame) -> DataFrame:
    """`coded` with label_error, the sum of errors over equal labels (null ones together); beyond a long, the largest one.

    Sums are added up before they cross the network.  Where labels are too many
    to broadcast, each label's sum goes to SALTS places, so that one label's
    rows meet it in as many tasks.
    """
    salt = unused(coded, "salt")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    few = small(sums)
    if few is not sums:
        return coded.join(few, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    many = sums.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn(salt, F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(many, F.col("label").eqNullSafe(F.col("of")) & (F.col(salt) == F.col("share"))).drop("of", "share", salt)


def oracle() -> str:
    """The same codes in another engine's SQL: every vector's part against every entry, round by round, over whole numbers in doubles."""

    def nearest_of(k: int) -> str:
        pair = "CAST(x.xx - 2 * list_inner_product(x.x, c.x) + c.xx AS BIGINT)"
        return f"SELECT x.n, x.p, CAST(min({pair} * {ENTRIES} + c.e) AS BIGINT) AS best FROM x JOIN c{k} c USING (p) GROUP BY x.n, x.p"

    steps = []
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED ({nearest_of(k)})")
        steps.append(
            f"""m{k} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS x FROM (
  SELECT a.p, a.best % {ENTRIES} AS e, t.i, floor(CAST(sum(x.x[t.i]) AS DOUBLE) / count(*)) AS m
  FROM a{k} a JOIN x USING (n, p) JOIN places t USING (p) GROUP BY a.p, a.best % {ENTRIES}, t.i) GROUP BY p, e)"""
        )
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, x, list_inner_product(x, x) AS xx FROM (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (p, e)))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(v)) // {PARTS} AS w FROM v),
x AS MATERIALIZED (
  SELECT n, p, x, list_inner_product(x, x) AS xx
  FROM (SELECT n, p, v[p * w + 1 : (p + 1) * w] AS x FROM v, w, (SELECT unnest(range({PARTS})) AS p))),
places AS (SELECT p, i FROM w, (SELECT unnest(range({PARTS})) AS p), LATERAL (SELECT unnest(range(1, w.w + 1)) AS i)),
c0 AS MATERIALIZED (SELECT p, n - 1 AS e, x, xx FROM x WHERE n <= {ENTRIES}),
{", ".join(steps)},
last AS MATERIALIZED ({nearest_of(ROUNDS)}),
coded AS (
  SELECT n, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM last GROUP BY n),
books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (n), books
"""
