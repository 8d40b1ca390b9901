"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share TILE consecutive words (or all words of
a shorter item) meet by such seeds.  Where seeds reach enough of an item's words,
tiling marks the longest common run of words that is not marked yet, again and
again, down to TILE words; runs of a length are found by Karp-Rabin hashing.
Tiles may stand in any order and anywhere in the text, so a passage whose parts
are moved or scattered is covered too.  A document holds an item if its tiles
cover COVERAGE or more of the item's words.

Items are a stated query set: they go to the workers in blocks of BLOCK_BYTES
at most, and documents are read once for each block.  Words are lower-cased;
punctuation doesn't count.
"""

from __future__ import annotations

import functools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import appended, bounded_batches, slices, unused
from cairn.llm.licenses import words_of

TILE, COVERAGE = 3, 0.8
BLOCK_BYTES = 16 << 20
_BASE = 1_000_003


def karp_rabin(ids: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the windows of `size` free words; negative words are in none."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bad = np.concatenate([[0], np.cumsum(~free | (ids < 0))])
    starts = np.flatnonzero(bad[size:] == bad[:-size])
    part, width = ids.astype(np.uint64) + np.uint64(1), 1  # hashes of `width` words, doubled
    whole, done, base = np.zeros(len(ids), np.uint64), 0, _BASE
    while True:
        if size & width:
            shifted = np.zeros_like(part)
            shifted[: len(part) - done] = part[done:]
            whole, done = whole * np.uint64(base) + shifted, done + width
        if 2 * width > size:
            return starts, whole[starts]
        ahead = np.zeros_like(part)
        ahead[: len(part) - width] = part[width:]
        part, width, base = part * np.uint64(base) + ahead, 2 * width, base * base % (1 << 64)


def common_runs(item: np.ndarray, text: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(words, start in item, start in text) of the longest common runs of `size` free words or more, one for each run.

    A run is extended from its first word only, all runs a word at a time, so
    texts that repeat themselves cost item times text in short array operations,
    not in runs times their length.
    """
    i_at, i_hash = karp_rabin(item, free_a, size)
    j_at, j_hash = karp_rabin(text, free_b, size)
    order = np.lexsort((j_at, j_hash))
    j_at, j_hash = j_at[order], j_hash[order]
    first, last = np.searchsorted(j_hash, i_hash, "left"), np.searchsorted(j_hash, i_hash, "right")
    before = np.append(np.where(free_b, text, -1), -1)  # the last one stands before the first word
    found_i, found_j = [], []
    for i, a, z in zip(i_at.tolist(), first.tolist(), last.tolist(), strict=True):
        if z > a:
            j = j_at[a:z]
            if i and free_a[i - 1] and item[i - 1] >= 0:
                j = j[before[j - 1] != item[i - 1]]  # else the run has begun before
            found_i.append(np.full(len(j), i))
            found_j.append(j)
    if not found_i:
        return (np.zeros(0, np.int64),) * 3
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    n, on = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(on):
        x, y = i[on] + n[on], j[on] + n[on]
        inside = (x < len(item)) & (y < len(text))
        on, x, y = on[inside], x[inside], y[inside]
        on = on[free_a[x] & free_b[y] & (item[x] == text[y]) & (item[x] >= 0)]
        n[on] += 1
    real = n >= size
    return n[real], i[real], j[real]


def tiles(item: list[int], text: list[int], least: int = TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, words), longest first; negative words match nothing."""
    a, b = np.asarray(item, np.int64), np.asarray(text, np.int64)
    free_a, free_b, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    size = max(least, min(len(a), len(b), 32))
    while True:
        n, i, j = common_runs(a, b, free_a, free_b, size)
        if len(n) and (most := int(n.max())) > 2 * size:
            size = most
            continue
        while len(n):
            top = np.flatnonzero(n == n.max())
            best = top[np.lexsort((j[top], i[top]))[0]]
            m, p, q = int(n[best]), int(i[best]), int(j[best])
            out.append((p, q, m))
            free_a[p : p + m], free_b[q : q + m] = False, False
            # of runs that the tile meets, what follows it is left
            skip = np.maximum(np.where((i < p + m) & (i + n > p), p + m - i, 0), np.where((j < q + m) & (j + n > q), q + m - j, 0))
            n, i, j = n - skip, i + skip, j + skip
            left = n >= size
            n, i, j = n[left], i[left], j[left]
        if size == least:
            return out
        size = max(least, size // 2)


class Index:
    """Seeds of a block of items, each with its items and the places in them that it covers, as bits."""

    def __init__(self, items: list[tuple[object, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.keys = [k for k, _ in items]
        self.items = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t.lower())] for _, t in items]
        self.sizes = sorted({min(TILE, len(ids)) for ids in self.items if ids})
        self.seeds: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, ids in enumerate(self.items):
            size, bits = min(TILE, len(ids)), defaultdict(int)
            for i in range(len(ids) - size + 1 if ids else 0):
                bits[tuple(ids[i : i + size])] |= ((1 << size) - 1) << i
            for seed, at in bits.items():
                self.seeds[seed].append((k, at))

    def matches(self, text: str | None, coverage: float) -> list[tuple[object, int, int]]:
        """(item, its words, words covered by tiles) for each item that the text covers to `coverage`."""
        ids = [-1 if i is None else i for i in map(self.vocabulary.get, words_of((text or "").lower()))]
        known = np.concatenate([[0], np.cumsum(np.fromiter((i >= 0 for i in ids), np.int64, len(ids)))])
        places: dict[tuple[int, ...], list[int]] = {}
        for size in self.sizes:
            for i in np.flatnonzero(known[size:] - known[:-size] == size).tolist() if len(ids) >= size else ():
                if (seed := tuple(ids[i : i + size])) in self.seeds:
                    places.setdefault(seed, []).append(i)
        reached, shared = defaultdict(int), defaultdict(list)
        for seed in places:
            for k, bits in self.seeds[seed]:
                reached[k] |= bits
                shared[k].append(seed)
        out = []
        for k, bits in reached.items():
            n = len(self.items[k])
            if bits.bit_count() >= coverage * n:  # a word outside of shared seeds is in no tile
                covered = self._covered(self.items[k], ids, shared[k], places)
                if covered >= coverage * n:
                    out.append((self.keys[k], n, covered))
        return out

    @staticmethod
    def _covered(item: list[int], ids: list[int], shared: list[tuple[int, ...]], places: dict[tuple[int, ...], list[int]]) -> int:
        """Words of the item that tiles cover, over the whole text: what lies between shared seeds matches nothing and counts as one place."""
        near, last = [], -1
        for i in sorted({i + d for seed in shared for i in places[seed] for d in range(len(seed))}):
            if i > last + 1:
                near.append(-1)
            near.append(ids[i])
            last = i
        return sum(n for _, _, n in tiles(item, near, min(TILE, len(item))))


def contaminated(df: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_words, covered, coverage) for each document and item that it holds.

    A null or empty text holds nothing, and an item without a word is held by
    none; one under TILE words is held where all of it stands.  Repeated rows of either side give repeated results; null ids stay
    null.  Other columns play no part.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    kinds = dict(docs.dtypes)
    bench = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    schema = f"doc_id {kinds['doc_id']}, item_id {dict(bench.dtypes)['item_id']}, n_words long, covered long"
    item_type = bench.schema["item_id"].dataType
    out = spark.createDataFrame([], schema)
    for share in _blocks(bench):
        out = out.unionByName(docs.mapInArrow(functools.partial(_block, share, item_type, coverage), schema))
    return out.withColumn("coverage", F.col("covered") / F.col("n_words")).where(F.col("coverage") >= coverage)


def clean(df: DataFrame, text: str, items: DataFrame, item_text: str, *, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `df` that hold none of `items`; they are decided on where they are read, without a join."""
    bench = items.select(F.lit(0).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    held = unused(df, "held")
    out = df.withColumn(held, F.lit(False))
    for share in _blocks(bench):

        def work(b: pa.RecordBatch, share=share) -> list[pa.Array]:
            index = _index(share)
            return [pa.array([h or bool(index.matches(t, coverage)) for t, h in zip(b.column(text).to_pylist(), b.column(held).to_pylist(), strict=True)], pa.bool_())]

        out = appended(out, text, {held: "boolean"}, work)
    return out.where(~F.col(held)).drop(held)


def _blocks(bench: DataFrame) -> Iterator:
    """The items (item_id, text) in broadcasts (name, items) of BLOCK_BYTES or so."""
    n_bytes = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-n_bytes // BLOCK_BYTES)
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield bench.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r["item_id"], r["text"]) for r in rows]))


_INDEX: dict[str, Index] = {}


def _index(share) -> Index:
    """The index of a broadcast block, built once in a worker."""
    name, items = share.value
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Index(items)
    return _INDEX[name]


def _block(share, item_type, coverage: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_type

    index = _index(share)
    for whole in batches:
        for b in slices(whole, "text"):
            row, key, n_words, covered = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for item, n, c in index.matches(t, coverage):
                    row.append(i)
                    key.append(item)
                    n_words.append(n)
                    covered.append(c)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(key, to_arrow_type(item_type)), pa.array(n_words, pa.int64()), pa.array(covered, pa.int64())], ["doc_id", "item_id", "n_words", "covered"])
