"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of `length` bytes around it also starts earlier in the
corpus.  The longest previous factor of a position is the longest string that
starts there and also earlier.  In suffix order it is shared with the previous
or the next smaller position (by document, then place), whichever has more in
common; a string of `length` bytes is a later copy exactly where the longest
previous factor has that length.

One suffix array of a corpus fits no machine, so suffixes are brought together
by content first.  Of every window of `length` bytes the least hashed run of
GRAM bytes is its anchor; equal windows have equal anchors.  A window is a
suffix to be sorted only if its anchor occurs elsewhere, and it is sorted in
the shard of its anchor:

1. texts, dealt by document: anchors with the stretches of windows they stand
   for.  Equal stretches of a task are settled there (all but the first go).
2. by anchor: those that occur once are done.
3. by document: the text of the other stretches is cut out,
4. by anchor: their suffix array, smaller positions and longest previous
   factors, and the windows these cover,
5. by document: covered bytes are cut away.

An anchor that takes a large part of a shard by itself (as a SAMPLE of texts
tells; a wrong guess changes no result) is split by content: each distinct
window around it goes by its own hash, as a hash and a place without text, and
equal ones are settled in step 2 like suffixes of equal rank.

Texts are shuffled once, as steps 1, 3 and 5 read the same exchange.  Equal
documents are settled before: all but the first are covered from end to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, checkpointed, mix64, slices, tidy, tidy_group

LENGTH, GRAM = 100, 32
#: Bytes of text whose anchors are computed at once, and anchors that a task holds before it sends them on.
PIECE, HELD = 1 << 20, 400_000
#: Windows around hot anchors that a task holds before it sends them on.
HELD_WINDOWS = 1_000_000
#: Bytes of text a shard stands for at most.
SHARD_BYTES = 64 << 20
#: One text in SAMPLE is looked at for hot anchors: those with more than a HOT-th of a shard's stretches, and LEAST_HOT in the sample.
SAMPLE, HOT, LEAST_HOT = 50, 4, 16

_ANCHOR = np.dtype([("h", "<u8"), ("id", "<i8"), ("tie", "<i8"), ("s", "<u4"), ("n", "u1")])
_CONTEXT = np.dtype([("id", "<i8"), ("tie", "<i8"), ("s", "<u4"), ("n", "u1")])
_WINDOW = np.dtype([("w", "<u8"), ("h", "<u8"), ("id", "<i8"), ("tie", "<i8"), ("s", "<u4")])
_STRETCH = np.dtype([("h", "<u8"), ("s", "<u4"), ("n", "u1")])
_SPAN = np.dtype([("a", "<i8"), ("b", "<i8")])
_ODD, _WHERE = 0x9E3779B97F4A7C15, np.uint64((1 << 28) - 1)


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self, n: int):
        self.up, self.down = (np.full(n + 1, x, np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
        for powers in (self.up, self.down):
            powers[0] = 1
            np.cumprod(powers, out=powers)
        self.byte = mix64(np.arange(1, 257, dtype=np.uint64))


def anchors(data: np.ndarray, ends: np.ndarray, powers: Powers, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with the same anchor in texts that stand one after another, each ending at one of `ends`.

    Returns first and last window start, the anchor's hash, the hash of the bytes from the first window's start to the last one's end, and prefix sums from which `hashed` takes the hash of any bytes.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(powers.byte[data] * powers.up[:n])])
        grams = mix64((sums[GRAM:] - sums[:-GRAM]) * powers.down[: n - GRAM + 1])
    key = (grams & ~_WHERE) | np.arange(len(grams), dtype=np.uint64)
    wide, reach = length - GRAM + 1, 1
    while 2 * reach <= wide:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if wide > reach:
        key = np.minimum(key[: len(key) - (wide - reach)], key[wide - reach :])
    at = (key & _WHERE).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(n + 1, np.int64)  # windows that lie within one text
    long_ = ends - starts >= length
    np.add.at(whole, starts[long_], 1)
    np.add.at(whole, ends[long_] - length + 1, -1)
    whole = np.cumsum(whole)[: len(at)] > 0
    text = np.searchsorted(ends, np.arange(len(at)), side="right")
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]) & whole
    first = np.flatnonzero(new)
    stop = np.flatnonzero(whole & ~np.concatenate([whole[1:] & ~new[1:], [False]]))
    return first, stop, grams[at[first]], hashed(sums, powers, first, stop + length), sums


def hashed(sums: np.ndarray, powers: Powers, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each of `a` to each of `b`."""
    with np.errstate(over="ignore"):
        return mix64((sums[b] - sums[a]) * powers.down[a] + (b - a).astype(np.uint64))


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of possibly overlapping or touching spans."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans["a"], kind="stable")]
    reach = np.maximum.accumulate(spans["b"])
    new = np.concatenate([[True], spans["a"][1:] > reach[:-1]])
    out = np.zeros(int(new.sum()), _SPAN)
    out["a"], out["b"] = spans["a"][new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` ordered by their first `length` bytes, and for each whether its stretch of equal ones begins.

    Eight bytes at a time; only stretches that are not uniform are sorted again.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    word = words[starts].astype(np.uint64)
    order = np.argsort(word, kind="stable")
    word = word[order]
    new = np.concatenate([[True], word[1:] != word[:-1]]) if len(order) else np.zeros(0, bool)
    for offset in offsets[1:]:
        shared = ~new
        shared[:-1] |= ~new[1:]
        slots = np.flatnonzero(shared)
        if not len(slots):
            break
        word = words[starts[order[slots]] + offset].astype(np.uint64)
        group = np.cumsum(new[slots])
        differs = np.concatenate([[False], (word[1:] != word[:-1]) & (group[1:] == group[:-1])])
        if not differs.any():
            continue
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[differs]] = True
        some = mixed[group]
        slots, word, group = slots[some], word[some], group[some]
        by = np.lexsort((word, group))
        order[slots], word = order[slots][by], word[by]
        new[slots] |= np.concatenate([[True], word[1:] != word[:-1]])
    return order, new


def common_prefixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Per suffix, in order: the bytes, up to `length`, that it has in common with the one before; none for the first."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    out = np.zeros(len(starts), np.int64)
    left = np.arange(1, len(starts))
    for offset in range(0, length, 8):
        at = np.minimum(offset, length - 8)
        differ = words[starts[left] + at].astype(np.uint64) ^ words[starts[left - 1] + at].astype(np.uint64)
        same = sum((differ < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8)) + (differ == 0)
        out[left] = at + same
        left = left[differ == 0]
    return out


def smaller(place: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in order: the nearest one before it with a smaller place (-1: none), and what both have in common.

    Steps go from one candidate to that one's own, all suffixes at once, as
    long as what is in common reaches `least`; where it doesn't, it is 0.
    """
    before, shared = np.arange(len(place)) - 1, common.copy()
    left = np.arange(len(place))
    while len(left):
        left = left[(before[left] >= 0) & (shared[left] >= least)]
        left = left[place[before[left]] >= place[left]]
        at = before[left]
        before[left], shared[left] = before[at], np.minimum(shared[left], shared[at])
    shared[(before < 0) | (shared < least)] = 0
    return before, shared


def previous_factors(place: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest-previous-factor array: per suffix, in order, the bytes it has in common with one that starts earlier; 0 if under `least`."""
    _, back = smaller(place, common, least)
    turned = np.concatenate([[0], common[1:][::-1]]) if len(common) else common
    _, ahead = smaller(place[::-1], turned, least)
    return np.maximum(back, ahead[::-1])


def _stretches(first: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(begin, end) of each stretch of `n` items, given where they begin."""
    return list(zip(first.tolist(), [*first[1:].tolist(), n], strict=True)) if n else []


def _by_document(ids: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by document and where each document begins in it."""
    order = np.lexsort((ties, ids))
    i, t = ids[order], ties[order]
    return order, np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])])) if len(order) else order


def _span_rows(ids: np.ndarray, ties: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list, list, list]:
    """Spans packed by document."""
    order, first = _by_document(ids, ties)
    blobs = []
    for x, y in _stretches(first, len(order)):
        spans = np.zeros(y - x, _SPAN)
        spans["a"], spans["b"] = a[order[x:y]], b[order[x:y]]
        blobs.append(merged(spans).tobytes())
    return ids[order][first].tolist(), ties[order][first].tolist(), blobs


_SENT = pa.schema([("shard", pa.int32()), ("id", pa.int64()), ("tie", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_FOUND = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
#: What a blob holds: spans that go, anchors with their stretches, windows of hot anchors, text around anchors.
_SPANS, _STRETCHES, _WINDOWS, _TEXT = 0, 1, 2, 3


def _sent(shard: np.ndarray | list, ids: list | None, ties: list | None, kind: int, blobs: list) -> pa.RecordBatch:
    n = len(blobs)
    ends = [pa.array(c, pa.int64()) if c is not None else pa.nulls(n, pa.int64()) for c in (ids, ties)]
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *ends, pa.array(np.full(n, kind, np.int32)), pa.array(blobs, pa.binary())], schema=_SENT)


def _dealt(recs: np.ndarray, key: str, kind: int, shards: int) -> pa.RecordBatch:
    """Records packed by the shard of their key."""
    shard = (recs[key] % np.uint64(shards)).astype(np.int32)
    by = np.argsort(shard, kind="stable")
    recs, shard = recs[by], shard[by]
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    return _sent(shard[first], None, None, kind, [recs[x:y].tobytes() for x, y in _stretches(first, len(recs))])


def _settled(recs: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records that stand behind an equal one (by all of `same`) of an earlier place, and the first of each kind."""
    order = np.lexsort((recs["s"], recs["tie"], recs["id"], *same[::-1]))
    r = recs[order]
    equal = np.ones(max(0, len(r) - 1), bool)
    for c in same:
        equal &= c[order][1:] == c[order][:-1]
    equal = np.concatenate([[False], equal])[: len(r)]
    gone, kept = r[equal], r[~equal]
    lead = np.maximum.accumulate(np.where(equal, 0, np.arange(len(r))))[equal]
    later = (r["id"][lead] != gone["id"]) | (r["tie"][lead] != gone["tie"]) | (r["s"][lead] != gone["s"])
    return gone[later], kept  # a repeated row is no earlier copy of itself


def hot_anchors(length: int):
    """Anchors of texts with how many stretches each has: (h, n)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(PIECE + length)
        for whole in batches:
            for b in slices(whole, "text", PIECE):
                for text in b.column("text"):
                    raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
                    found = [anchors(piece := raw[at : at + PIECE + length - 1], np.array([len(piece)]), powers, length)[2] for at in range(0, max(1, len(raw) - length + 1), PIECE)]
                    h, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return part


def _find(shards: int, length: int, hot: np.ndarray):
    """Step 1: (shard, null, null, anchors or windows of hot ones) and, of what is settled here, (shard, id, tie, spans)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, sizes, windows, many = Powers(PIECE + length), [], 0, [], 0

        def gone_spans(gone: np.ndarray, n: np.ndarray | int) -> Iterator[pa.RecordBatch]:
            start = gone["s"].astype(np.int64)
            ids, ties, blobs = _span_rows(gone["id"], gone["tie"], start, start + n + length)
            if ids:
                yield _sent((np.asarray(ids, np.int64).view(np.uint64) % np.uint64(shards)).astype(np.int32), ids, ties, _SPANS, blobs)

        def send() -> Iterator[pa.RecordBatch]:
            recs, content = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            gone, kept = _settled(recs, recs["h"], content, recs["n"])
            yield from gone_spans(gone, gone["n"].astype(np.int64))
            yield _dealt(kept, "h", _STRETCHES, shards)

        def send_windows() -> Iterator[pa.RecordBatch]:
            recs = np.concatenate(windows)
            windows.clear()
            gone, kept = _settled(recs, recs["w"], recs["h"])
            yield from gone_spans(gone, 0)
            yield _dealt(kept, "w", _WINDOWS, shards)

        def take(texts: list[tuple[int, int, int, bytes]]) -> None:
            data = np.frombuffer(b"".join(t[3] for t in texts), np.uint8)
            ends = np.cumsum([len(t[3]) for t in texts])
            first, stop, h, content, sums = anchors(data, ends, powers, length)
            begin = np.array([t[2] for t in texts], np.int64) - (ends - [len(t[3]) for t in texts])
            ids, ties = np.array([t[0] for t in texts], np.int64), np.array([t[1] for t in texts], np.int64)
            is_hot = np.isin(h, hot)
            if is_hot.any():
                n = (stop - first)[is_hot] + 1
                at = np.repeat(first[is_hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                of = np.searchsorted(ends, at, side="right")
                recs = np.zeros(len(at), _WINDOW)
                recs["w"], recs["h"] = hashed(sums, powers, at, at + length), np.repeat(h[is_hot], n)
                recs["id"], recs["tie"], recs["s"] = ids[of], ties[of], at + begin[of]
                windows.append(recs)
                first, stop, h, content = first[~is_hot], stop[~is_hot], h[~is_hot], content[~is_hot]
            of = np.searchsorted(ends, first, side="right")
            recs = np.zeros(len(first), _ANCHOR)
            recs["h"], recs["n"] = h, stop - first
            recs["id"], recs["tie"], recs["s"] = ids[of], ties[of], first + begin[of]
            held.append((recs, content))

        waiting, size = [], 0
        for b in batches:
            for id_, tie, text in zip(b.column("id").to_pylist(), b.column("tie").to_pylist(), b.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for at in range(0, max(1, len(raw) - length + 1), PIECE):  # windows that start in [at, at + PIECE)
                    piece = raw[at : at + PIECE + length - 1]
                    if len(piece) < length:
                        continue
                    if size + len(piece) > PIECE + length and waiting:
                        before = len(windows)
                        take(waiting)
                        sizes, many = sizes + len(held[-1][0]), many + sum(map(len, windows[before:]))
                        waiting, size = [], 0
                        if many >= HELD_WINDOWS:
                            yield from send_windows()
                            many = 0
                    waiting.append((id_, tie, at, piece))
                    size += len(piece)
                if sizes >= HELD:
                    yield from send()
                    sizes = 0
        if waiting:
            take(waiting)
        if held:
            yield from send()
        if windows:
            yield from send_windows()

    return part


def _held(t: pa.Table, kind: int) -> list[bytes]:
    return t.filter(pc.equal(t.column("kind"), kind)).column("blob").to_pylist()


def _passed(t: pa.Table) -> pa.Table:
    """Spans that were settled before."""
    return t.filter(pc.equal(t.column("kind"), _SPANS)).select(["id", "tie", "kind", "blob"])


def _found(ids: list, ties: list, kind: int, blobs: list) -> pa.Table:
    return pa.table([pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(blobs, pa.binary())], schema=_FOUND)


def _shared(length: int):
    """Step 2: of a shard's anchors those that occur more than once, packed by document; spans of later windows of hot anchors; spans that pass through."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        recs = np.frombuffer(b"".join(_held(t, _STRETCHES)), _ANCHOR)
        order = np.argsort(recs["h"], kind="stable")
        h = recs["h"][order]
        same = h[1:] == h[:-1]
        recs = recs[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(h) else recs
        order, first = _by_document(recs["id"], recs["tie"])
        recs = recs[order]
        packed = np.zeros(len(recs), _STRETCH)
        packed["h"], packed["s"], packed["n"] = recs["h"], recs["s"], recs["n"]
        found = _found(recs["id"][first].tolist(), recs["tie"][first].tolist(), _STRETCHES, [packed[x:y].tobytes() for x, y in _stretches(first, len(recs))])
        windows = np.frombuffer(b"".join(_held(t, _WINDOWS)), _WINDOW)
        gone, _ = _settled(windows, windows["w"], windows["h"])
        start = gone["s"].astype(np.int64)
        ids, ties, blobs = _span_rows(gone["id"], gone["tie"], start, start + length)
        return pa.concat_tables([found, _found(ids, ties, _SPANS, blobs), _passed(t)])

    return work


def _cut(shards: int, length: int):
    """Step 3: the text of each document's stretches, by shard; spans pass through."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[bytes]] = {}
        size = 0
        for b in batches:
            kept: tuple[list, list, list, list] = ([], [], [], [])
            for id_, tie, text, found in zip(b.column("id").to_pylist(), b.column("tie").to_pylist(), b.column("text"), b.column("found").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if spans := [f["blob"] for f in found if f["kind"] == _SPANS]:  # a row a document, however many shards have settled some
                    for column, v in zip(kept, (id_ % shards, id_, tie, merged(np.frombuffer(b"".join(spans), _SPAN)).tobytes()), strict=True):
                        column.append(v)
                for f in found:
                    if f["kind"] == _SPANS:
                        continue
                    at = np.frombuffer(f["blob"], _STRETCH)
                    head = np.zeros(len(at), _CONTEXT)
                    head["id"], head["tie"], head["s"], head["n"] = id_, tie, at["s"], at["n"]
                    heads = head.tobytes()
                    for k, (shard, s, n) in enumerate(zip((at["h"] % np.uint64(shards)).tolist(), at["s"].tolist(), at["n"].tolist(), strict=True)):
                        waiting.setdefault(shard, []).append(heads[k * _CONTEXT.itemsize : (k + 1) * _CONTEXT.itemsize] + raw[s : s + n + length])
                        size += n + length + _CONTEXT.itemsize
            if kept[0]:
                yield _sent(kept[0], kept[1], kept[2], _SPANS, kept[3])
            if size > 32 << 20:
                yield flush(waiting)
                size = 0
        if waiting:
            yield flush(waiting)

    def flush(waiting: dict[int, list[bytes]]) -> pa.RecordBatch:
        out = _sent(list(waiting), None, None, _TEXT, [b"".join(v) for v in waiting.values()])
        waiting.clear()
        return out

    return part


def _heads(data: np.ndarray, length: int) -> np.ndarray:
    """Where the stretches of a blob begin: each is as long as its header says."""
    at, out, n_at, total = 0, [], _CONTEXT.fields["n"][1], len(data)
    step = _CONTEXT.itemsize + length
    n_of = data.tobytes()
    while at < total:
        out.append(at)
        at += step + n_of[at + n_at]
    return np.array(out, np.int64)


def _covered(length: int):
    """Step 4: the suffix array of a shard; (id, tie, spans) of windows with a previous factor, and the spans that pass through."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(_held(t, _TEXT)), np.uint8)
        if not len(data):
            return _passed(t)
        at = _heads(data, length)
        head = data[at[:, None] + np.arange(_CONTEXT.itemsize)].copy().view(_CONTEXT).ravel()
        by, first = _by_document(head["id"], head["tie"])
        rank = np.zeros(len(at), np.int64)
        rank[by] = np.cumsum(np.isin(np.arange(len(by)), first)) << 32
        by = np.lexsort((head["s"], rank))  # by place, so that equal suffixes stand in its order
        at, head, rank = at[by], head[by], rank[by]
        many = head["n"].astype(np.int64) + 1
        of = np.repeat(np.arange(len(at)), many)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        starts = at[of] + _CONTEXT.itemsize + offset
        position = head["s"].astype(np.int64)[of] + offset
        order, _ = suffix_order(data, starts, length)
        factors = previous_factors((rank[of] + position)[order], common_prefixes(data, starts[order], length), length)
        gone = order[factors >= length]
        where = of[gone]
        ids, ties, blobs = _span_rows(head["id"][where], head["tie"][where], position[gone], position[gone] + length)
        return pa.concat_tables([_found(ids, ties, _SPANS, blobs), _passed(t)])

    return work


def _remove(length: int):
    """Step 5: what is left of each document."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, removed, runs, digests, spans_out = [], [], [], [], []
            for text, first, blobs in zip(b.column("text"), b.column("first").to_pylist(), b.column("blobs").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if not first and len(raw) >= length:
                    spans = [(0, len(raw))]
                else:
                    spans = merged(np.frombuffer(b"".join(blobs or ()), _SPAN)).tolist()
                kept, at = hashlib.sha256(), 0
                for x, y in spans:
                    kept.update(raw[at:x])
                    at = y
                kept.update(raw[at:])
                n_bytes.append(len(raw))
                removed.append(sum(y - x for x, y in spans))
                runs.append(len(spans))
                digests.append(kept.hexdigest())
                spans_out.append([{"start": x, "end": y} for x, y in spans])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return part


def _hot(df: DataFrame, text: str, length: int, shards: int) -> np.ndarray:
    """Anchors that would take a HOT-th of a shard or more by themselves, by a sample; no more than HOT * shards of them."""
    some = df.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(SAMPLE)) == 0).distinct()
    counts = some.mapInArrow(tidy(hot_anchors(length)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts.where(F.col("n") > 1))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return np.array([r["h"] for r in counts.where(F.col("n") > max(LEAST_HOT, total / (HOT * shards))).select("h").collect()], np.int64).view(np.uint64)


def repeats(df: DataFrame, doc_id: str, text: str, *, length: int = LENGTH) -> DataFrame:
    """Per row of `df`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans array<(start, end)> of removed bytes.

    Ids are integers; null ids come before all others.  Documents with equal
    ids stand in the order of their texts' MD5 digests; rows with equal ids and
    texts are one document, and each gets its result.  Null texts count as
    empty; nothing goes from a text under `length` bytes.  Whole texts, any
    length: they are worked on in pieces of PIECE bytes.
    """
    if not 2 * GRAM < length <= 255:
        raise ValueError(f"length must be in ({2 * GRAM}, 255]")
    spark = df.sparkSession
    bounded_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(body)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), F.coalesce(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(0).cast("long")).alias("tie"), body.alias("text"), digest.alias("md5"))
    n_bytes = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES))
    firsts = rows.groupBy("md5").agg(F.min(F.struct("id", "tie")).alias("f")).select("f.id", "f.tie")
    texts = rows.select("doc_id", "id", "tie", "text").repartition(shards, "id", "tie")  # written once: all who read it take every column, and none needs a null test
    sent_as = "shard int, id long, tie long, kind int, blob binary"
    hot = _hot(df, text, length, shards)
    sent = texts.join(firsts.hint("shuffle_hash"), ["id", "tie"]).select("doc_id", "id", "tie", "text").mapInArrow(tidy(_find(shards, length, hot)), sent_as)
    found = sent.groupBy("shard").applyInArrow(tidy_group(_shared(length)), "id long, tie long, kind int, blob binary")
    wanted = found.groupBy("id", "tie").agg(F.collect_list(F.struct("kind", "blob")).alias("found"))  # no more than a document holds
    cut = texts.join(wanted.hint("shuffle_hash"), ["id", "tie"]).mapInArrow(tidy(_cut(shards, length)), sent_as)
    covered = cut.groupBy("shard").applyInArrow(tidy_group(_covered(length)), "id long, tie long, kind int, blob binary")
    status = firsts.select("id", "tie", F.lit(1).alias("first"), F.lit(None).cast("binary").alias("blob")).unionByName(covered.select("id", "tie", F.lit(0).alias("first"), "blob"))
    status = status.groupBy("id", "tie").agg(F.max("first").alias("first"), F.collect_list("blob").alias("blobs"))
    done = texts.join(status.hint("shuffle_hash"), ["id", "tie"], "left").select("doc_id", "text", (F.coalesce("first", F.lit(0)) == 1).alias("first"), "blobs")
    kind = dict(df.select(F.col(doc_id).alias("d")).dtypes)["d"]
    return done.mapInArrow(tidy(_remove(length)), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
