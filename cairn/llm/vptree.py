"""Nearest neighbours by cosine with vantage-point trees, a tree per shard.

Vectors are scaled to length one, where the chord is a metric that falls as the
cosine rises.  A sample of PIVOTS vectors at most deals all others into cells by
the nearest pivot; a cell is a shard, or several by a hash of the id where it
holds more than SHARD_BYTES.  In its own shard a query learns a chord t within
which it has enough neighbours, and goes to those cells that may hold something
as near: the triangle inequality bounds a cell's chords from below, by its radius
and by its border with the query's own cell.  There a tree is searched: a node
splits its vectors at the median chord mu from its vantage point, and a query at
chord d enters the far side only if |d - mu| <= factor * t, t being the best
bound so far.  Nothing is lost at factor one; smaller factors skip more, cells
and branches alike.

Vectors cross the network once.  Where they lie without structure, as random
directions in many dimensions do, no bound tells cells apart, and every query
sees all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, checkpointed, tidy

#: Pivots at most; bytes of a shard's vectors; bytes of the queries that meet a shard at once; vectors of a leaf.
PIVOTS, SHARD_BYTES, QUERY_BYTES, LEAF = 1024, 8 << 20, 32 << 20, 64
#: Relaxation of the pruning.
FACTOR = 0.8
#: Slack of bounds, and decimals beyond which cosines are ties: more than rounding takes.
SLACK, DECIMALS = 1e-9, 12


def usable(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: positions and vectors that are not null, not zero and hold finite numbers only."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    lists = vectors.cast(pa.list_(pa.float64()))
    valid = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)  # null components turn to nan
    lengths = np.diff(offsets)
    for dim in np.unique(lengths[valid]).tolist():
        if not dim:
            continue
        at = np.flatnonzero(valid & (lengths == dim))
        m = flat[offsets[:-1][at][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        if ok.any():
            out[dim] = at[ok], m[ok]
    return out


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows with their largest component near one, by powers of two: no bit of a component changes, nothing overflows."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    m = scaled(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision from the vectors as they are."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Tree:
    """A vantage-point tree over unit vectors."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.points, self.leaf, self.random = points, leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        some = self.random.choice(at, min(len(at), 5), replace=False)
        sample = self.random.choice(at, min(len(at), 64), replace=False)
        spread = ((self.points[some] @ self.points[sample].T)).std(axis=1)
        vantage = some[spread.argmax()]
        d = chord(self.points[at] @ self.points[vantage])
        mu = np.median(d)
        inner = d <= mu
        if inner.all():
            return at
        return vantage, mu, self._build(at[inner]), self._build(at[~inner])

    def search(self, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of the k nearest points found, and of all that are as near as the k-th.

        `bound`: a chord per query within which k points are known to be, here or elsewhere.
        """
        least = np.full(len(queries), -np.inf) if bound is None else 1 - bound**2 / 2 - SLACK  # cosines from which on points count
        best, found = np.full((len(queries), k), -np.inf), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def visit(node, qs: np.ndarray) -> None:
            if not len(qs):
                return
            if isinstance(node, np.ndarray):
                for i in range(0, len(qs), 4096):
                    q = qs[i : i + 4096]
                    c = queries[q] @ self.points[node].T
                    x, y = np.nonzero(c >= least[q][:, None])
                    found.append((q[x], node[y], c[x, y]))
                    top = np.concatenate([best[q], c], axis=1)
                    best[q] = np.partition(top, top.shape[1] - k, axis=1)[:, -k:]
                    least[q] = np.maximum(least[q], best[q].min(axis=1) - SLACK)
                return
            vantage, mu, inner, outer = node
            d = chord(queries[qs] @ self.points[vantage])
            close = d <= mu
            near, far = qs[close], qs[~close]
            visit(inner, near)
            visit(outer, far)
            visit(outer, near[mu - d[close] <= factor * chord(least[near]) + SLACK])
            visit(inner, far[d[~close] - mu <= factor * chord(least[far]) + SLACK])

        visit(self.root, np.arange(len(queries)))
        q, p, c = (np.concatenate(f) for f in zip(*found, strict=True))
        kept = c >= least[q]
        return q[kept], p[kept]


def _ranked(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first by score, then id, of each query."""
    order = np.lexsort((ids, -score.round(DECIMALS), q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], ids[first], score[first]


def shard_nearest(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, cosine) of the k nearest in a shard for each query, itself left out.

    Equal vectors are one point of the tree that holds its k + 1 least ids: no more can be among the nearest.
    """
    order = np.lexsort((ids, *points.T[::-1]))
    ids, points = ids[order], points[order]
    first = np.flatnonzero(np.concatenate([[True], (points[1:] != points[:-1]).any(axis=1)]))
    many = np.minimum(np.diff(np.append(first, len(ids))), k + 1)
    distinct = points[first]
    # one more than k: the query's own point may be among them
    q, p = Tree(unit(distinct)).search(unit(queries), min(k + 1, len(distinct)), factor, bound)
    score = cosine(queries[q], distinct[p]) if len(q) else np.zeros(0)
    q, score, n, start = np.repeat(q, many[p]), np.repeat(score, many[p]), many[p], np.repeat(first[p], many[p])
    id_ = ids[start + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]
    other = id_ != query_ids[q]
    return _ranked(q[other], id_[other], score[other], k)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _dealer(pivots: dict[int, np.ndarray]):
    """Vectors in use: (dim, cell, d, id, asked, v), d the chord to the cell's pivot. A length without a pivot is a cell, -1."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, (at, m) in usable(b.column("id"), b.column("v")).items():
                cell, d = np.full(len(at), -1), np.full(len(at), 2.0)
                if dim in pivots:
                    for i in range(0, len(at), 4096):
                        c = unit(m[i : i + 4096]) @ pivots[dim].T
                        cell[i : i + 4096], d[i : i + 4096] = c.argmax(axis=1), chord(c.max(axis=1))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(d), b.column("id").take(rows), b.column("asked").take(rows), pa.array([x.tobytes() for x in m], pa.binary())],
                    ["dim", "cell", "d", "id", "asked", "v"],
                )

    return part


def _router(pivots: dict[int, np.ndarray], radii: dict[tuple[int, int], float], k: int, factor: float):
    """Queries of a shard -> (dim, cell, id, v, bound) for each cell that they go to."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        asked = t.filter(t.column("asked"))
        if not asked.num_rows:
            return _ROUTED.empty_table()
        points, queries = unit(_matrix(t.column("v"), dim)), unit(_matrix(asked.column("v"), dim))
        ids, own = t.column("id").to_numpy(), asked.column("id").to_numpy()
        bound = np.full(len(own), 2.0)
        for i in range(0, len(own), 1024):
            c = np.where(ids[None, :] == own[i : i + 1024, None], -1.0, queries[i : i + 1024] @ points.T)
            if c.shape[1] > k:
                bound[i : i + 1024] = chord(np.partition(c, c.shape[1] - k, axis=1)[:, -k]) + SLACK
        cells = [c for d, c in radii if d == dim]
        go = np.ones((len(own), len(cells)), bool)
        if dim in pivots:
            d = chord(queries @ pivots[dim][cells].T)
            home = asked.column("d").to_numpy()
            low = np.maximum(d - np.array([radii[dim, c] for c in cells]), (d - home[:, None]) / 2)
            go = low <= factor * bound[:, None] + SLACK
        q, c = np.nonzero(go)
        rows = pa.array(q)
        return pa.table([pa.array(np.full(len(q), dim, np.int32)), pa.array(np.array(cells, np.int32)[c]), asked.column("id").take(rows), asked.column("v").take(rows), pa.array(bound[q])], schema=_ROUTED)

    return work


_ROUTED = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("id", pa.int64()), ("v", pa.binary()), ("bound", pa.float64())])
_HITS = pa.schema([("query", pa.int64()), ("q", pa.binary()), ("id", pa.int64()), ("score", pa.float64())])


def _searcher(k: int, factor: float):
    def work(key: tuple, shard: pa.Table, asked: pa.Table) -> pa.Table:
        if not shard.num_rows or not asked.num_rows:
            return _HITS.empty_table()
        dim, ids = key[0].as_py(), asked.column("id").to_numpy()
        q, i, score = shard_nearest(shard.column("id").to_numpy(), _matrix(shard.column("v"), dim), ids, _matrix(asked.column("v"), dim), k, factor, asked.column("bound").to_numpy())
        digests = [hashlib.md5(v).digest() for v in asked.column("v").to_pylist()]
        return pa.table([pa.array(ids[q]), pa.array([digests[x] for x in q.tolist()], pa.binary()), pa.array(i), pa.array(score)], schema=_HITS)

    return work


def nearest(df: DataFrame, vec_id: str, vector: str, is_query: str | Column, *, k: int = 5, factor: float = FACTOR, pivots: int = PIVOTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows that are found for each row where `is_query` (over the columns of `df`) holds.

    Ids are integers.  A vector that is null, empty, zero or holds null or
    non-finite components takes no part, nor does one without an id; a query
    sees vectors of its own length.  A row with the query's id is no candidate;
    of repeated ids each row is one.  A repeated query id is answered once per
    distinct vector.  Cosines that differ by rounding only (DECIMALS) are ties,
    and ties go to the smaller id; where there are fewer than k candidates, all
    are returned.  The index is fitted on `pivots` vectors at most, taken by a
    hash of their ids, and holds every row.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    asked = F.expr(is_query) if isinstance(is_query, str) else is_query
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    size = rows.agg(F.coalesce(F.sum(8.0 * F.size("v")), F.lit(0.0))).first()[0]
    most = max(1, min(pivots, int(size // shard_bytes)))
    got = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(most).select("id", "v").toArrow()
    # a shard each where there are no more than `pivots`; a bounded sample
    centres = {dim: np.unique(unit(m), axis=0) for dim, (_, m) in usable(got.column("id").combine_chunks(), got.column("v").combine_chunks()).items()} if got.num_rows else {}
    dealt = checkpointed(rows.mapInArrow(tidy(_dealer(centres)), "dim int, cell int, d double, id long, asked boolean, v binary"))
    cells = dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()  # a row a cell
    radii = {(r["dim"], r["cell"]): r["radius"] for r in cells}
    many = spark.createDataFrame([(r["dim"], r["cell"], -(-r["n"] * 8 * r["dim"] // shard_bytes)) for r in cells], "dim int, cell int, many int")
    many = F.broadcast(many)  # `pivots` rows or so
    shards = dealt.join(many, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("many")).cast("int")).drop("many")
    shards = shards.repartition("dim", "cell", "sub")  # read by the router and by the search
    routed = shards.groupBy("dim", "cell", "sub").applyInArrow(_router(centres, radii, k, factor), "dim int, cell int, id long, v binary, bound double")
    routed = routed.groupBy("dim", "cell", "id", "v").agg(F.min("bound").alias("bound"))
    blocks = max(1, int(-(-dealt.where("asked").agg(F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()[0] // QUERY_BYTES)))
    routed = routed.join(many, ["dim", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    keys = ["dim", "cell", "sub"]
    if blocks > 1:  # more queries than one task should hold: a shard meets them a block at a time
        keys.append("block")
        shards = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hits = shards.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(_searcher(k, factor), "query long, q binary, id long, score double")
    order = Window.partitionBy("query", "q").orderBy(F.desc(F.round("score", DECIMALS)), "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
