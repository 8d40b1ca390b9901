"""Nearest points by a k-d split that follows the density of the points.

A sample of bounded size gives a balanced tree of medians, LEAVES leaves at most,
which all tasks hold.  Points and queries go down it to their leaf.  What a leaf
has more than LEAF points lies in blocks of that size, and queries in chunks, so
no group grows with the data or with one dense place; of points at the very same
place only the k + 1 least ids count, as no other can be among the k nearest.

A query first keeps the k best of its own leaf, whose distance is its bound; then
it visits the other leaves whose boxes are no further than that.  Results are
exact, ties to the lesser id.

With cells, only points of the 27 grid cells about a query's own may be found:
others are passed over in a group, and leaves are visited only where they meet
those cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.shared import checkpointed

AXES = "xyz"
#: Points of a leaf and queries of a chunk that meet in one group, leaves at most, and sampled points for each.
LEAF, CHUNK, LEAVES, SAMPLED = 2048, 8192, 1 << 15, 32
#: Distances held at once.
TILE = 1 << 20


class Tree:
    """Median cuts of a full binary tree, level by level: node k has the children 2k + 1 (less) and 2k + 2."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.axis, self.cut = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        parts = [sample]
        for node in range(len(self.axis)):
            part, parts[node] = parts[node], np.zeros((0, 3))
            if len(part):
                self.axis[node] = axis = int(np.ptp(part, axis=0).argmax())
                self.cut[node] = np.median(part[:, axis])
                right = part[:, axis] >= self.cut[node]
                parts += [part[~right], part[right]]
            else:
                parts += [part, part]

    def leaf(self, at: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(at), np.int64), np.arange(len(at))
        for _ in range(self.depth):
            node = 2 * node + 1 + (at[row, self.axis[node]] >= self.cut[node])
        return node - len(self.axis)

    def within(self, at: np.ndarray, bound: np.ndarray, cell: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of the leaves whose box is no further from a point than its squared bound, and meets the cells about it."""
        row, node, off = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros((len(at), 3))
        for _ in range(self.depth):
            axis = self.axis[node]
            diff = at[row, axis] - self.cut[node]
            right = diff >= 0
            far = off.copy()
            far[np.arange(len(row)), axis] = np.abs(diff)
            reached = far[:, 0] * far[:, 0] + far[:, 1] * far[:, 1] + far[:, 2] * far[:, 2] <= bound[row]
            if cell is not None:  # the other side's nearest cell is that of the cut
                reached &= np.abs(_cells(at[row, axis], cell) - _cells(self.cut[node], cell)) <= 1
            node = np.concatenate([2 * node + 1 + right, (2 * node + 2 - right)[reached]])
            row, off = np.concatenate([row, row[reached]]), np.concatenate([off, far[reached]])
        return row, node - len(self.axis)


def _cells(at: np.ndarray, cell: float) -> np.ndarray:
    return np.floor(at / cell)


def best(q: np.ndarray, qid: np.ndarray, p: np.ndarray, pid: np.ndarray, k: int, exclude_self: bool, cell: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance) of the k nearest of `p` to each of `q`, by index; pid's order settles ties; with `cell`, of the points in the 27 cells about."""
    rows, cols, far = [], [], []
    wide = []  # axes along which a pair may be more than a cell apart
    if cell is not None and len(q) and len(p):
        qc, pc = _cells(q, cell), _cells(p, cell)
        wide = [i for i in range(3) if max(qc[:, i].max() - pc[:, i].min(), pc[:, i].max() - qc[:, i].min()) > 1]
    for a in range(0, len(q), max(1, TILE // max(1, len(p)))):
        part = q[a : a + max(1, TILE // max(1, len(p)))]
        d = [part[:, None, i] - p[None, :, i] for i in range(3)]
        d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        if exclude_self:
            d2[qid[a : a + len(part), None] == pid[None, :]] = np.inf
        for i in wide:
            d2[np.abs(qc[a : a + len(part), None, i] - pc[None, :, i]) > 1] = np.inf
        if len(p) > k:
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
            x, y = np.nonzero((d2 <= kth[:, None]) & np.isfinite(d2))
        else:
            x, y = np.nonzero(np.isfinite(d2))
        order = np.lexsort((pid[y], d2[x, y], x))
        x, y = x[order], y[order]
        starts = np.searchsorted(x, x)
        first = np.arange(len(x)) - starts < k
        rows.append(x[first] + a)
        cols.append(y[first])
        far.append(d2[x[first], y[first]])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(far)


def _places(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(a).to_numpy(zero_copy_only=False) for a in AXES], axis=1).astype(float)


def _dealt(rows: DataFrame, tree: Tree, repeats: np.ndarray, own: np.ndarray, kind: str, bounded: bool = False, mine: str = "block", theirs: str = "chunk", cell: float | None = None) -> DataFrame:
    """`rows` (id, x, y, z) with their leaf, a place among `own` of it by id (`mine`), repeated for each of `repeats` (`theirs`).

    `bounded` rows have a bound too, and go to the other leaves within it.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(b)
            if bounded:
                row, leaf = tree.within(at, b.column("bound").to_numpy(zero_copy_only=False), cell)
                other = leaf != tree.leaf(at)[row]
                row, leaf = row[other], leaf[other]
            else:
                row, leaf = np.arange(len(at)), tree.leaf(at)
            salt = b.column("salt").to_numpy()[row] % own[leaf]
            times = repeats[leaf]
            each = np.repeat(np.arange(len(row)), times)
            copy = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            kept = b.take(pa.array(row[each]))
            yield pa.RecordBatch.from_arrays([kept.column(n) for n in ("id", *AXES)] + [pa.array(leaf[each]), pa.array(salt[each]), pa.array(copy)], ["id", *AXES, "leaf", mine, theirs])

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    return salted.mapInArrow(part, f"id {kind}, x double, y double, z double, leaf long, {mine} long, {theirs} long")


def _counted(rows: DataFrame, tree: Tree, bounded: bool = False, cell: float | None = None) -> np.ndarray:
    """How many of `rows` each leaf gets; as many numbers as the tree has leaves."""
    one = np.ones(1 << tree.depth, np.int64)
    got = np.zeros(1 << tree.depth, np.int64)
    for r in _dealt(rows, tree, one, one, dict(rows.dtypes)["id"], bounded, cell=cell).groupBy("leaf").count().collect():
        got[r["leaf"]] = r["count"]
    return got


def _visited(queries: DataFrame, points: DataFrame, tree: Tree, k: int, exclude_self: bool, held: np.ndarray, bounded: bool, cell: float | None) -> DataFrame:
    """(query_id, point_id, d2): the k best for each query in each block of the leaves that it visits."""
    kinds = dict(queries.dtypes)["id"], dict(points.dtypes)["id"]
    blocks = -(-held // LEAF)
    chunks = -(-_counted(queries, tree, bounded, cell) // CHUNK)
    q = _dealt(queries, tree, blocks, np.maximum(chunks, 1), kinds[0], bounded, "chunk", "block", cell)
    p = _dealt(points, tree, chunks, np.maximum(blocks, 1), kinds[1], False, "block", "chunk")

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(left) and len(right):
            ids = np.concatenate([t.column("id").to_numpy() for t in (left, right)])
            order = np.unique(ids, return_inverse=True)[1]
            places = [np.stack([t.column(a).to_numpy() for a in AXES], axis=1) for t in (left, right)]
            found = best(places[0], order[: len(left)], places[1], order[len(left) :], k, exclude_self, cell)
        return pa.table({"query_id": left.column("id").take(pa.array(found[0])), "point_id": right.column("id").take(pa.array(found[1])), "d2": pa.array(found[2])})

    keys = ["leaf", "block", "chunk"]
    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(work, f"query_id {kinds[0]}, point_id {kinds[1]}, d2 double")


def _located(df: DataFrame, name: str) -> DataFrame:
    """(id, x, y, z) of the rows of `df` with a finite place."""
    at = df.select(F.col(name).alias("id"), *(F.col(a).cast("double").alias(a) for a in AXES))
    return at.where(" and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('infinity')" for a in AXES))


def nearest(queries: DataFrame, points: DataFrame, k: int, *, qid: str = "id", pid: str = "id", exclude_self: bool = False, cell: float | None = None) -> DataFrame:
    """(query_id, rank, point_id, d2): the k nearest points of each query, exactly; ties to the lesser id; fewer if there are no more.

    With `cell`, the nearest of those in the 27 grid cells of that width about the query's own.

    Ids are distinct among queries and among points.  Queries and points without
    a finite place take no part.  No point, no row.
    """
    asked, given = _located(queries, qid), _located(points, pid)
    nth = F.row_number().over(Window.partitionBy(*AXES).orderBy("id"))  # limited before the shuffle, too
    given = checkpointed(given.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"))
    n = given.count()
    leaves = min(LEAVES, max(1, -(-n // LEAF)))
    share = min(1.0, 1.2 * leaves * SAMPLED / max(1, n))
    sample = given.select(*AXES).sample(share, 7).limit(2 * leaves * SAMPLED).collect() if n else []  # the tree alone depends on it, no result
    tree = Tree(np.array([tuple(r) for r in sample], float).reshape(-1, 3), leaves)
    held = _counted(given, tree)
    own = checkpointed(_visited(asked, given, tree, k, exclude_self, held, False, cell))
    best_of = F.slice(F.array_sort(F.collect_list(F.struct("d2", "point_id"))), 1, k)
    first = own.groupBy("query_id").agg(best_of.alias("found"))
    full = F.when(F.size("found") >= k, F.element_at("found", -1)["d2"]).otherwise(F.lit(float("inf")))
    bound = first.select(F.col("query_id").alias("id"), full.alias("bound"))
    wide = checkpointed(asked.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
    others = _visited(wide, given, tree, k, exclude_self, held, True, cell)
    whole = own.unionByName(others).groupBy("query_id").agg(best_of.alias("found"))
    return whole.select("query_id", F.posexplode("found").alias("at", "f")).select("query_id", (F.col("at") + 1).alias("rank"), "f.point_id", "f.d2")
