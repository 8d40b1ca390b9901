"""Near-duplicates by SimHash: exact comparison of fingerprints, tile by tile.

A fingerprint has a bit for each bit position that more than half of a text's
shingle hashes set.  Distinct fingerprints are dealt into tiles of one
population count each; only pairs of tiles whose counts differ by no more than
the radius are compared, each pair in one task, with numpy's exclusive-or and
bit counts over blocks that fit the cache.  (Two fingerprints whose population
counts differ by more than the radius differ in more bits than that.)  The same
holds for the counts of their quarters, added up: within tiles, fingerprints are
ordered by these, and blocks that are too far apart are skipped.  A task returns a spanning forest of the links it finds, never all pairs of a group.

Tiles hold a TILES-th of the fingerprints, so each fingerprint is sent to TILES
tasks or so at any size; comparing all of them is quadratic by the method.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import appended, checkpointed, mix64, repeated, small
from cairn.llm.components import connected

WIDTH, RADIUS, SEED = 4, 4, 42
#: Min-hashes of a sketch.
SKETCH = 32
#: Tiles over all population counts, and the fingerprints that a tile holds at least and at most (8 bytes each).
TILES, LEAST, MOST = 40, 2048, 1 << 21
#: Tiles of nodes with sketches (56 bytes each), dealt by hash: a wide radius leaves out few pairs of population counts.
SKETCHED = 16
#: Sets of shingles that meet in a task: bytes and nodes of a block of a component, of which a task holds two at most.
SETS_BYTES, SETS_NODES = 16 << 20, 4096
#: Rows and columns of a block of comparisons, and the columns that are compared at once.
BLOCK, AT_ONCE = (64, 64), 4096


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The XXH64 of each shingle of a text, repeats included: of the whole text if it has fewer words; none without a word or for null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes set; zero without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


_FACTORS = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH min-hashes, 15 bits of each: two texts agree in about the share of them that is their shingles' Jaccard similarity."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(out, (hashes[i : i + 4096, None] * _FACTORS[None, :]).min(axis=0), out=out)
    return (mix64(out) >> np.uint64(49)).astype(np.int16)


def fingerprints(df: DataFrame, text: str, width: int = WIDTH) -> DataFrame:
    """`df` with fp, the fingerprint's 64 bits as a long."""

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        got = [fingerprint(shingles(t, width)) for t in b.column(text).to_pylist()]
        return [pa.array(np.array(got, np.uint64).view(np.int64))]

    return appended(df, text, {"fp": "long"}, work)


def shingle_sets(df: DataFrame, text: str, width: int) -> DataFrame:
    """`df` with node, a digest of the set of shingles (zero if empty), and the set's fingerprint and sketch."""

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        got = [np.unique(shingles(t, width)) for t in b.column(text).to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) if len(h) else 0 for h in got], np.uint64)
        fp = np.array([fingerprint(h) for h in got], np.uint64)
        return [pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), pa.array([sketch(h).astype(np.uint8).tobytes() for h in got], pa.binary())]

    return appended(df, text, {"node": "long", "fp": "long", "sketch": "binary"}, work)


class Forest:
    """Union-find over `n` numbered items that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        _, first = np.unique(ra.astype(np.int64) * len(self.root) + rb, return_index=True)
        for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
            p, q = x, y
            while self.root[p] != p:
                p = self.root[p]
            while self.root[q] != q:
                q = self.root[q]
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self.links.append((x, y))
        while (self.root != (up := self.root[self.root])).any():
            self.root = up


def quarters(fps: np.ndarray) -> np.ndarray:
    """The population counts of each fingerprint's four quarters."""
    return np.bitwise_count((fps[:, None] >> (np.uint64(16) * np.arange(4, dtype=np.uint64))) & np.uint64(0xFFFF)).astype(np.int16)


def ordered(fps: np.ndarray) -> np.ndarray:
    """Fingerprints by the population counts of their quarters, so that blocks of them span few."""
    return fps[np.lexsort(quarters(fps).T[::-1])]


def _ranges(fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest counts of the quarters in each block of `size`."""
    q, first = quarters(fps), np.arange(0, len(fps), size)
    return np.minimum.reduceat(q, first, axis=0), np.maximum.reduceat(q, first, axis=0)


def compare(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the tiles a and b, or within a where b is None.

    Blocks whose quarters' population counts differ by more than the radius, all
    four together, are skipped, as tiles are; the others are compared whole.
    """
    rows, columns = ordered(a), ordered(a if b is None else b)
    both = rows if b is None else np.concatenate([rows, columns])
    forest, at = Forest(len(both)), 0 if b is None else len(rows)
    (low, top), (low_c, top_c) = _ranges(rows, BLOCK[0]), _ranges(columns, BLOCK[1])
    for k, i in enumerate(range(0, len(rows), BLOCK[0])):
        gap = np.maximum(0, np.maximum(low_c - top[k], low[k] - top_c)).sum(axis=1)
        near_blocks = np.flatnonzero(gap <= radius)
        if b is None:
            near_blocks = near_blocks[(near_blocks + 1) * BLOCK[1] > i]  # what comes before has met these rows
        cols = (near_blocks[:, None] * BLOCK[1] + np.arange(BLOCK[1])).ravel()
        cols = cols[cols < len(columns)]
        for j in range(0, len(cols), AT_ONCE):
            some = cols[j : j + AT_ONCE]
            close = np.bitwise_count(rows[i : i + BLOCK[0], None] ^ columns[some][None, :]) <= radius
            if close.any():
                x, y = np.nonzero(close)
                forest.join(x + i, some[y] + at)
    links = np.array(forest.links, np.int64).reshape(-1, 2)
    return both[links[:, 0]], both[links[:, 1]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fps` (fp) as all pairs within `radius` bits do."""
    spark = fps.sparkSession
    sizes = {r["p"]: r["n"] for r in fps.groupBy(F.bit_count("fp").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    each = min(MOST, max(LEAST, -(-sum(sizes.values()) // TILES)))
    tiles = [(p, i) for p in sorted(sizes) for i in range(-(-sizes[p] // each))]
    at = {p: tiles.index((p, 0)) for p in sizes}
    pairs = [(k, x, y) for k, (x, y) in enumerate((x, y) for x in range(len(tiles)) for y in range(x, len(tiles)) if tiles[y][0] - tiles[x][0] <= radius)]
    if not pairs:
        return spark.createDataFrame([], "a long, b long")
    # population count -> first tile and number of tiles
    rows = [(p, at[p], -(-sizes[p] // each)) for p in sorted(sizes)]
    plan = F.broadcast(spark.createDataFrame(rows, "p int, first int, many int"))  # 65 rows at most
    dealt = fps.withColumn("p", F.bit_count("fp")).join(plan, "p").select("fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("many"))).cast("int").alias("tile"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "fps": pa.array([np.sort(t.column("fp").to_numpy()).tobytes()], pa.binary())})

    packed = dealt.groupBy("tile").applyInArrow(pack, "tile int, fps binary")
    members = [(x, k, 0) for k, x, _ in pairs] + [(y, k, 1) for k, x, y in pairs if y != x]
    jobs = F.broadcast(spark.createDataFrame(members, "tile int, pair int, side int"))  # a few thousand rows by TILES

    def work(key: tuple, t: pa.Table) -> pa.Table:
        by = {s: np.frombuffer(f, np.int64).view(np.uint64) for s, f in zip(t.column("side").to_pylist(), t.column("fps").to_pylist(), strict=True)}
        a, b = compare(by[0], by.get(1), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return packed.join(jobs, "tile").groupBy("pair").applyInArrow(work, "a long, b long")


def candidates(a: np.ndarray, b: np.ndarray | None, radius: int, agree: int, sure: int) -> np.ndarray:
    """Links of nodes of the tiles a and b, or within a, that pass both tests: fingerprints within `radius`, sketches equal in `agree` places.

    A spanning forest of all that pass, and one of those whose sketches are
    equal in `sure` places.  A row: two nodes, the lesser first, and the equal places.
    """
    rows = a[np.lexsort(quarters(a["fp"]).T[::-1])]
    columns = rows if b is None else b[np.lexsort(quarters(b["fp"]).T[::-1])]
    both = rows if b is None else np.concatenate([rows, columns])
    at = 0 if b is None else len(rows)
    forests = [(agree, Forest(len(both))), (sure, Forest(len(both)))]
    (low, top), (low_c, top_c) = _ranges(rows["fp"], BLOCK[0]), _ranges(columns["fp"], BLOCK[1])
    x_fp, y_fp = np.ascontiguousarray(rows["fp"]), np.ascontiguousarray(columns["fp"])
    for k, i in enumerate(range(0, len(rows), BLOCK[0])):
        gap = np.maximum(0, np.maximum(low_c - top[k], low[k] - top_c)).sum(axis=1)
        near_blocks = np.flatnonzero(gap <= radius)
        if b is None:
            near_blocks = near_blocks[(near_blocks + 1) * BLOCK[1] > i]
        cols = (near_blocks[:, None] * BLOCK[1] + np.arange(BLOCK[1])).ravel()
        cols = cols[cols < len(columns)]
        for j in range(0, len(cols), AT_ONCE):
            some = cols[j : j + AT_ONCE]
            x, y = np.nonzero(np.bitwise_count(x_fp[i : i + BLOCK[0], None] ^ y_fp[some][None, :]) <= radius)
            x, y = x + i, some[y]
            if b is None:
                x, y = x[x < y], y[x < y]
            same = (rows["sketch"][x] == columns["sketch"][y]).sum(axis=1)
            for least, forest in forests:
                if (hit := same >= least).any():
                    forest.join(x[hit], y[hit] + at)
    x, y = np.unique(np.concatenate([np.array(f.links, np.int64).reshape(-1, 2) for _, f in forests]), axis=0).T
    same = (both["sketch"][x] == both["sketch"][y]).sum(axis=1)
    x, y = both["node"][x], both["node"][y]
    return np.stack([np.minimum(x, y), np.maximum(x, y), same], axis=1)


_NODE = np.dtype([("node", "<i8"), ("fp", "<u8"), ("sketch", "u1", SKETCH)])


def _candidates(nodes: DataFrame, radius: int, agree: int, sure: int) -> DataFrame:
    """Candidate links (a, b, same) of `nodes` (node, fp, sketch), as many as nodes and tiles at most. See `candidates`."""
    spark, n = nodes.sparkSession, nodes.count()
    many = max(min(SKETCHED, -(-n // LEAST)), -(-n // MOST))
    pairs = [(k, x, y) for k, (x, y) in enumerate((x, y) for x in range(many) for y in range(x, many))]
    if not pairs:
        return spark.createDataFrame([], "a long, b long, same long")
    members = [(x, k, 0) for k, x, _ in pairs] + [(y, k, 1) for k, x, y in pairs if y != x]
    jobs = F.broadcast(spark.createDataFrame(members, "tile int, pair int, side int"))  # a few hundred rows by SKETCHED

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        out = np.zeros(t.num_rows, _NODE)
        out["node"] = t.column("node").to_numpy()
        out["fp"] = t.column("fp").to_numpy().view(np.uint64)
        out["sketch"] = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "held": pa.array([out.tobytes()], pa.binary())})

    def work(key: tuple, t: pa.Table) -> pa.Table:
        by = {s: np.frombuffer(f, _NODE) for s, f in zip(t.column("side").to_pylist(), t.column("held").to_pylist(), strict=True)}
        got = candidates(by[0], by.get(1), radius, agree, sure)
        return pa.table({c: pa.array(np.ascontiguousarray(got[:, i])) for i, c in enumerate(("a", "b", "same"))})

    dealt = nodes.select("node", "fp", "sketch", F.pmod(F.xxhash64("node"), F.lit(many)).cast("int").alias("tile"))
    packed = dealt.groupBy("tile").applyInArrow(pack, "tile int, held binary")
    return packed.join(jobs, "tile").groupBy("pair").applyInArrow(work, "a long, b long, same long")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (a, b) whose sets of shingles (node, held) have the Jaccard similarity `similarity` or more."""
    x, y = sets.select(F.col("node").alias("a"), F.col("held").alias("x")), sets.select(F.col("node").alias("b"), F.col("held").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def similar_links(roots: np.ndarray, sides: np.ndarray | None, fps: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int, agree: int) -> list[tuple[int, int]]:
    """Positions (x, y) of links that connect what all pairs of Jaccard similarity `similarity` or more connect, besides equal roots.

    Pairs must pass the tests of `candidates`, and where there are `sides`,
    stand on both.  What is connected already is not compared again.
    """
    label, out = np.unique(roots, return_inverse=True)[1], []
    sizes = np.array([len(h) for h in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    ids = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    mark = np.zeros(int(max((i.max(initial=-1) for i in ids), default=-1)) + 1, bool)
    for x in range(len(sets) - 1):
        y = np.arange(x + 1, len(sets))
        y = y[(label[y] != label[x]) & (np.bitwise_count(fps[y] ^ fps[x]) <= radius) & (np.minimum(sizes[y], sizes[x]) >= similarity * np.maximum(sizes[y], sizes[x]))]
        if sides is not None:
            y = y[sides[y] != sides[x]]
        y = y[(sketches[y] == sketches[x]).sum(axis=1) >= agree]
        if not len(y) or not sizes[x]:
            continue
        mark[ids[x]] = True
        both = np.add.reduceat(mark[np.concatenate([ids[j] for j in y])], np.cumsum(sizes[y]) - sizes[y], dtype=np.int64)
        mark[ids[x]] = False
        for j in y[both >= similarity * (sizes[x] + sizes[y] - both)].tolist():
            if label[j] != label[x]:
                out.append((x, j))
                label[label == label[j]] = label[x]
    return out


def _block_links(similarity: float, radius: int, agree: int):
    """Links within each component of a table (component, root, side, node, fp, sketch, held); sides are null where all pairs count."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("component", "ascending"), ("node", "ascending")])
        component, node, root = (t.column(c).to_numpy() for c in ("component", "node", "root"))
        fps = t.column("fp").to_numpy().view(np.uint64)
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        held = t.column("held").combine_chunks()
        flat, at = held.values.to_numpy(), held.offsets.to_numpy()
        sides = None if t.column("side").null_count else t.column("side").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1]]))
        a, b = [], []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(node)], strict=True):
            sets = [flat[at[k] : at[k + 1]] for k in range(i, j)]
            got = similar_links(root[i:j], None if sides is None else sides[i:j], fps[i:j], sketches[i:j], sets, similarity, radius, agree)
            a += [node[i + x] for x, _ in got]
            b += [node[i + y] for _, y in got]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work


def similar(df: DataFrame, doc_id: str, text: str, *, width: int, similarity: float, radius: int, agree: int) -> DataFrame:
    """Per row of `df`: doc_id, tie and root, equal for texts that links connect: those whose sets of `width`-word shingles have the Jaccard similarity `similarity` or more.

    Of all pairs whose fingerprints differ in `radius` bits at most and whose
    sketches are equal in `agree` places or more, the exact similarity decides.
    Forests of these candidates settle which texts can be connected at all; the
    sets of such a component's texts then meet in one task, or in one for every
    two of its blocks where they are many, and only forests of confirmed links
    leave it.  Of a component of many blocks the likeliest links are confirmed
    first: blocks of what these connect already don't meet each other.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    docs = checkpointed(shingle_sets(rows, "text", width).drop("text"))
    nodes = checkpointed(docs.groupBy("node").agg(F.min("tie").alias("tie"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")))
    pairs = checkpointed(_candidates(nodes, radius, agree, int(similarity * SKETCH) + 1))
    component = connected(pairs).withColumnRenamed("root", "component")

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        got = [np.unique(shingles(t, width)) for t in b.column("text").to_pylist()]
        at = np.cumsum([0, *map(len, got)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.uint64), *got]).view(np.int64)))]

    some = checkpointed(nodes.join(component, "node"))  # only nodes that have a candidate go on
    texts = rows.select("tie", "text").join(small(some.select("tie", "node")), "tie").groupBy("node").agg(F.first("text").alias("text"))
    sets = checkpointed(appended(texts, "text", {"held": "array<long>"}, work).select("node", "held"))
    size = F.greatest(F.ceil(F.sum(F.lit(8) * F.size("held")) / F.lit(SETS_BYTES)), F.ceil(F.count(F.lit(1)) / F.lit(SETS_NODES))).cast("int")
    sized = checkpointed(some.join(sets, "node").groupBy("component").agg(size.alias("blocks")))
    verify = _block_links(similarity, radius, agree)
    fields = ("component", "root", "side", "node", "fp", "sketch", "held")
    bundles = max(1, int(sets.agg(F.coalesce(F.sum(F.size("held")), F.lit(0))).first()[0] * 8 // SETS_BYTES))
    one = some.join(sized.where("blocks <= 1").select("component"), "component", "left_semi").join(sets, "node")
    one = one.select(F.pmod(F.xxhash64("component"), F.lit(bundles)).alias("bundle"), "component", F.col("node").alias("root"), F.lit(None).cast("int").alias("side"), *fields[3:])
    confirmed = checkpointed(one.groupBy("bundle").applyInArrow(verify, "a long, b long"))
    if sized.where("blocks > 1").limit(1).count():
        large = checkpointed(some.join(sized.where("blocks > 1"), "component"))
        ends = [F.struct(F.col(x).alias("node"), F.col(y).alias("other"), F.col("same"), F.lit(x == "a").alias("less")) for x, y in (("a", "b"), ("b", "a"))]
        best = pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.*").join(large.select("node"), "node", "left_semi")
        best = best.groupBy("node", "less").agg(F.max(F.struct("same", "other")).alias("best"))
        best = best.select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b")).distinct()
        first = checkpointed(_confirmed(best, sets, similarity))
        rooted = large.join(connected(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
        core = rooted.groupBy("component", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("root", F.struct("n", "root")).alias("core"))
        dealt = rooted.join(core, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        # blocks 0, 1, ... of the core, blocks, blocks + 1, ... of the rest; two of the core don't meet
        dealt = dealt.withColumn("block", F.col("block") + F.when(F.col("root") == F.col("core"), 0).otherwise(F.col("blocks")))
        mine = F.col("block")
        meets = F.when(mine < F.col("blocks"), F.sequence(F.col("blocks"), 2 * F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), 2 * F.col("blocks") - 1))
        met = checkpointed(dealt).withColumn("other", F.explode(meets))
        met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).join(sets, "node")
        side = F.when(F.col("low") != F.col("high"), F.col("block"))
        across = met.select("low", "high", "component", "root", side.alias("side"), *fields[3:]).groupBy("component", "low", "high")
        confirmed = confirmed.union(first).union(checkpointed(across.applyInArrow(lambda k, t: verify(k, t.select(list(fields))), "a long, b long")))
    root = connected(confirmed)
    return docs.join(root, "node", "left").select("doc_id", "tie", F.coalesce("root", "node").alias("root"))


def groups(df: DataFrame, doc_id: str, text: str, *, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Per row of `df`: doc_id, tie (the text's MD5 digest), fp and component_id, the least id among all reachable by links.

    Fingerprints link at `radius` or fewer differing bits; equal ones always
    do, also those of empty and null texts (zero).  Null ids stay null and are
    least of nothing: a component without any id has a null component_id.
    Repeated rows are kept.  Other columns play no part.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    docs = checkpointed(fingerprints(rows, "text", width).drop("text"))
    reps = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    root = connected(links(reps.select("fp"), radius)).withColumnRenamed("node", "fp")
    labelled = reps.join(root, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = labelled.join(least, "root").select("fp", "root", "component_id")
    return docs.join(of, "fp").select("doc_id", "tie", "fp", "root", "component_id")


def near_duplicates(df: DataFrame, doc_id: str, text: str, *, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Per row of `df`: doc_id, fingerprint (16 lowercase hex digits) and component_id; see `groups`."""
    got = groups(df, doc_id, text, width=width, radius=radius)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, doc_id: str, text: str, *, width: int = WIDTH, radius: int = RADIUS, similarity: float = 0.0, agree: int = 0) -> DataFrame:
    """The rows of `df` but for one of each group: the least id stays (null ids last; of equal ids, the least digest of the text).

    Groups are those of `groups`, or with `similarity` over zero those of `similar`.
    """
    got = similar(df, doc_id, text, width=width, similarity=similarity, radius=radius, agree=agree) if similarity > 0 else groups(df, doc_id, text, width=width, radius=radius)
    kept = got.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie")).alias("k")).select("k.doc_id", "k.tie", F.lit(1).alias("copies"))
    return repeated(df, doc_id, text, kept)
