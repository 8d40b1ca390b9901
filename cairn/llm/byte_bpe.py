"""Byte-level BPE ids by replaying merges over a corpus of words, and their decoding.

Texts are cut into words (each match of the pattern).  All distinct words of a
block of texts that its worker doesn't know yet lie end to end in arrays, one
token a byte, each token linked to its neighbours.  An inverted index leads
from each pair that can merge, named by the token it makes, to the positions
where it stands.  Merges are applied in rank order over all words at once: the
least rank that stands anywhere goes first, its positions from left to right,
and only the pairs with the two touched neighbours are looked up anew.  Within
a word that is the tiktoken library's order: least rank first, leftmost of
equal ones.  A word that is itself a token is that token.

Texts stay where they lie.  What a worker knows is remembered up to a bound of
bytes, so a task needs neither a shuffle nor a table of all words.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import orc_tokens
from cairn.llm.common import appended

#: Distinct words that a worker remembers, the longest among them, and the pairs whose merges it remembers.
WORDS, LONGEST, PAIRS = 200_000, 64, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a rank file: a line each, the token in base 64 and its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {missing}")
    return ranks


class Merges:
    """The merges of a rank table, and their replay over many words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        self.first = np.array(pairs, np.int64)
        self.made: dict[int, int] = {}

    def merged(self, a: int, b: int) -> int:
        """The rank of the token that `a` and `b` make, or -1; remembered in `made`."""
        if len(self.made) > PAIRS:
            self.made.clear()
        got = self.made[a << 32 | b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return got

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (none empty), one after another, and where each word's end."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        n = len(data)
        last = np.zeros(n, bool)
        last[ends - 1] = True
        start = np.full(n, -1, np.int64)  # the rank of the pair that begins at a position
        start[:-1] = self.first[data[:-1], data[1:]]
        start[last] = -1
        # the index: rank -> positions, rising, so that each list is a heap
        held = np.flatnonzero(start >= 0)
        held = held[np.argsort(start[held], kind="stable")]
        kinds, cuts = np.unique(start[held], return_index=True)
        index = {int(r): part.tolist() for r, part in zip(kinds, np.split(held, cuts[1:]), strict=True)} if len(held) else {}
        order = [int(r) for r in kinds]
        after = np.where(last, -1, np.arange(1, n + 1))
        before = np.concatenate([[-1], np.where(last[:-1], -1, np.arange(n - 1))])
        tok, nxt, prv, pair = (array("q", x.astype(np.int64).tobytes()) for x in (self.single[data], after, before, start))
        made, merged = self.made, self.merged
        while order:
            rank = order[0]
            places = index[rank]
            while places and order[0] == rank:
                p = heappop(places)
                if pair[p] != rank:
                    continue  # gone or changed since it was listed
                q = nxt[p]
                tok[p], tok[q], pair[p], pair[q] = rank, -1, -1, -1
                nxt[p] = right = nxt[q]
                touched = []
                if right >= 0:
                    prv[right] = p
                    touched.append((p, rank, tok[right]))
                if (left := prv[p]) >= 0:
                    touched.append((left, tok[left], rank))
                for at, x, y in touched:
                    if (new := made.get(x << 32 | y)) is None:
                        new = merged(x, y)
                    pair[at] = new
                    if new >= 0:
                        if new in index:
                            heappush(index[new], at)
                        else:
                            index[new] = [at]
                            heappush(order, new)
            if not places and order[0] == rank:
                heappop(order)
                del index[rank]
        left = np.frombuffer(tok, np.int64)
        kept = left >= 0
        return left[kept].astype("<u4"), np.cumsum(kept)[ends - 1]


class Encoder(orc_tokens.Encoder):
    """Ids of whole texts, as its base encodes them between blanks, by replayed merges."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.pattern = Merges(read_ranks(path)), regex.compile(pattern)
        self.words: dict[str, tuple[int, ...]] = {}
        self._forget()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.pattern.findall(t) for t in texts]
        known, fresh = self.words, {}
        for words in cut:
            for w in words:
                if w not in known and w not in fresh:
                    fresh[w] = None
        ranks, bytes_of, todo = self.merges.ranks, [], []
        for w in fresh:
            b = w.encode()
            if (whole := ranks.get(b)) is not None:
                fresh[w] = (whole,)
            else:
                todo.append(w)
                bytes_of.append(b)
        if todo:
            ids, ends = (x.tolist() for x in self.merges.replay(bytes_of))
            for w, a, z in zip(todo, [0, *ends[:-1]], ends, strict=True):
                fresh[w] = tuple(ids[a:z])
        out = []
        for words in cut:
            row: list[int] = []
            for w in words:
                row += known[w] if w in known else fresh[w]
            out.append(np.array(row, "<u4"))
        if len(known) + len(fresh) > WORDS:
            known.clear()
        known.update((w, ids) for w, ids in islice(fresh.items(), WORDS) if len(w) <= LONGEST)
        return out

    def _spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = self._whole([" " + p for p in pieces.to_pylist()])
        return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([len(x) for x in each], dtype=np.int64)


@functools.cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@functools.cache
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _ids(texts: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of `texts` (null: empty) and where each one's end, with a leading zero."""
    ids, many = _encoder(path, pattern).encode(pc.fill_null(texts, ""))
    return ids, np.concatenate([[0], np.cumsum(many)]).astype(np.int64)


def encode(df: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """`df` with `ids` (array<int>) and `n_tokens`: the ids of each whole `text` by the ranks at `path`.

    Special tokens are ordinary text.  A null or empty text has no ids.  Rows
    stay as they are, repeated ones too; a column that bears one of the new
    names, in any case, is replaced.  An empty table stays empty.
    """

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        ids, ends = _ids(b.column(text), path, pattern)
        return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32))), pa.array(np.diff(ends))]

    return appended(df, text, {"ids": "array<int>", "n_tokens": "long"}, work)


def decode(df: DataFrame, ids: str, path: str) -> DataFrame:
    """`df` with `decoded` (binary): the bytes of each row's ids; null ids have null bytes, an id without a token is an error."""

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        token = _tokens(path)
        return [pa.array([None if row is None else b"".join([token[i] for i in row]) for row in b.column(ids).to_pylist()], pa.binary())]

    return appended(df.withColumn("_bytes", F.lit("")), "_bytes", {"decoded": "binary"}, work).drop("_bytes")


def round_trip(df: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """`df` with n_tokens, and in place of ids and the bytes they decode to their SHA-256 in hex (ids decimal, joined by commas).

    As `encode` and `decode`, but the ids don't leave the task.
    """

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        ids, ends = _ids(b.column(text), path, pattern)
        token, listed, decoded = _tokens(path), [], []
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            row = ids[a:z].tolist()
            listed.append(hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join(map(token.__getitem__, row))).hexdigest())
        return [pa.array(np.diff(ends)), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]

    return appended(df, text, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, work)
