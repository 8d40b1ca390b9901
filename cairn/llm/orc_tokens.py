"""Token ids in ORC files, read back stripe by stripe.

Documents are dealt to files by ranges of their id and written in ascending
order, a row each: part (the file's number in that order), doc_id, first (ids
of the file's documents before it), n_tokens and the ids.  ORC encodes the ids
by its integer run-length encoding and keeps row indexes and a Bloom filter on
doc_id, so readers take stripes in parallel and skip those without the ids they
ask for.  A manifest beside the files has each file's number of tokens; a
document's place among all ids is its file's sum plus `first`.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, slices, tidy

END = 0
#: Bytes of pieces and ids that a worker remembers, and the longest piece among them.
MEMORY_BYTES, LONGEST = 32 << 20, 64
#: Pieces that are encoded as one text.
TOGETHER = 200
STRIPE_BYTES, INDEX_ROWS, FALSE_POSITIVES = 32 << 20, 1000, 0.01

# White space that may join a neighbouring space in one token: a text where it occurs is encoded as a whole.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUNS = rf"{_SPACE} | {_SPACE}|\A{_SPACE}|{_SPACE}\z"


class Encoder:
    """Ids of whole texts, from the tokenizers library, piece by piece.

    A byte-level BPE of this kind always starts a new piece at a single space
    between two other characters, so a text may be cut there; the library
    encodes each distinct piece once, and those that come up again are
    remembered as one array of strings and one of ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(tokens.values()) + 1, bool)
        for token, i in tokens.items():
            self.opens[i] = token.startswith("\u0120")  # how this vocabulary writes a leading space
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.ends, self.hit = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, bool)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that follow a space, and where each one's end: many in one text, as only the first token of each begins with the space."""
        ids, ends, at = [], [], 0
        cuts = np.minimum(np.arange(0, len(pieces) + TOGETHER, TOGETHER), len(pieces))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pieces), pa.scalar(" ", pieces.type)).to_pylist()
        for k, text in enumerate(joined):
            got, n = self._whole([" " + text])[0], int(cuts[k + 1] - cuts[k])
            first = np.flatnonzero(self.opens[got])
            if len(first) == n and not first[0]:
                end = np.append(first[1:], len(got))
            else:  # a special token stands in some piece
                each = self._whole([" " + p for p in pieces.slice(cuts[k], n).to_pylist()])
                got, end = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(got)
            ends.append(end + at)
            at += len(got)
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([np.zeros(0, np.int64), *ends])

    def _learn(self, pieces: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        """Remember short pieces; over the bound, those that have not come up again go."""
        sizes = np.diff(ends, prepend=0)
        short = pc.binary_length(pieces).to_numpy(zero_copy_only=False) <= LONGEST
        self.known = pa.concat_arrays([self.known, pieces.filter(pa.array(short))])
        self.ids = np.concatenate([self.ids, ids[np.repeat(short, sizes)]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes[short])])
        self.hit = np.concatenate([self.hit, np.zeros(int(short.sum()), bool)])
        if self.known.nbytes + self.ids.nbytes > MEMORY_BYTES:
            keep, sizes = self.hit, np.diff(self.ends)
            self.known, self.ids = self.known.filter(pa.array(keep)), self.ids[np.repeat(keep, sizes)]
            self.ends, self.hit = np.concatenate([[0], np.cumsum(sizes[keep])]), np.zeros(int(keep.sum()), bool)
            if self.known.nbytes + self.ids.nbytes > MEMORY_BYTES // 2:
                self._forget()

    def _cut(self, texts: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`encode` for texts without runs of white space."""
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        pieces = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        firsts = self._whole(pieces.take(pa.array(offsets[:-1])).to_pylist())  # what begins a text follows no space
        coded = pieces.dictionary_encode()
        which, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_string())
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        fresh = words.filter(pa.array(new))
        ids, ends = self._spaced(fresh)
        # all that may be needed: remembered ids, new ones, first pieces, the end
        flat = np.concatenate([self.ids, ids, *firsts, end])
        upto = np.concatenate([self.ends, self.ends[-1] + ends, self.ends[-1] + len(ids) + np.cumsum([*map(len, firsts), len(end)])])
        at[new] = len(self.known) + np.arange(len(fresh))
        slots = np.empty(len(which) + len(texts), np.int64)  # every piece, and an end after each text
        slots[np.arange(len(which)) + np.repeat(np.arange(len(texts)), np.diff(offsets))] = at[which]
        slots[offsets[:-1] + np.arange(len(texts))] = len(self.known) + len(fresh) + np.arange(len(texts))
        slots[offsets[1:] + np.arange(len(texts))] = len(upto) - 2
        self.hit[at[~new]] = True
        self._learn(fresh, ids, ends)
        many = (upto[1:] - upto[:-1])[slots]
        reach = np.cumsum(many)
        got = flat[np.repeat(upto[slots] - (reach - many), many) + np.arange(reach[-1])]
        return got, np.add.reduceat(many, offsets[:-1] + np.arange(len(texts)))

    def encode(self, texts: pa.Array, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null), each text's followed by `end`, and how many each has."""
        tail = np.array(end, "<u4")
        if not len(texts):
            return tail[:0], np.zeros(0, np.int64)
        runs = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False).astype(bool)
        if not runs.any():
            return self._cut(texts, tail)
        whole = [np.concatenate([ids, tail]) for ids in self._whole(texts.filter(pa.array(runs)).to_pylist())]
        many = np.zeros(len(texts), np.int64)
        many[runs] = [len(x) for x in whole]
        out = np.concatenate(whole)
        if not runs.all():
            plain, many[~runs] = self._cut(texts.filter(pa.array(~runs)), tail)
            both, out = np.repeat(runs, many), np.concatenate([np.zeros(int(many.sum()) - len(out), "<u4"), out])
            out[both], out[~both] = np.concatenate(whole), plain
        return out, many


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write(df: DataFrame, doc_id: str, text: str, path: str, tokenizer: str, *, end: int | None = END, files: int | None = None) -> None:
    """Encode every whole text of `df` (null: empty) and write the files under `path`, with the manifest in `path`-manifest.

    `end`, if any, is appended to each document.  Null ids come first; rows
    with equal ids are ordered by text, so that reruns agree.  An empty table
    gives a readable table without rows.  `files`: the shuffle partitions of
    the session unless given.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tail = () if end is None else (end,)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, first = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in slices(whole, "text"):
                ids, many = encoder.encode(b.column("text"), tail)
                ends = np.cumsum(many)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(many), number, np.int32)), b.column("doc_id"), pa.array(first + ends - many), pa.array(many), lists], ["part", "doc_id", "first", "n_tokens", "ids"])
                first += int(ends[-1])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    out = ordered.mapInArrow(tidy(part), f"part int, doc_id {kind}, first long, n_tokens long, ids array<int>")
    options = {"compression": "zstd", "orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": INDEX_ROWS, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES}
    out.write.mode("overwrite").options(**{k: str(v) for k, v in options.items()}).orc(path)
    written = spark.read.schema("part int, n_tokens long").orc(path)  # two short columns of the files, no ids
    written.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).coalesce(1).write.mode("overwrite").orc(f"{path}-manifest")


def read(spark: SparkSession, path: str, kind: str = "bigint", doc_ids: list | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files under `path`; with `doc_ids`, only those, by row index and Bloom filter."""
    rows = spark.read.schema(f"part int, doc_id {kind}, first long, n_tokens long, ids array<int>").orc(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    manifest = spark.read.schema("part int, tokens long").orc(f"{path}-manifest").collect()  # a row for each file
    before, sums = 0, {}
    for r in sorted(manifest, key=lambda r: r["part"]):
        sums[r["part"]], before = before, before + r["tokens"]
    base = F.broadcast(spark.createDataFrame(list(sums.items()), "part int, base long"))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def with_crc(tokens: DataFrame) -> DataFrame:
    """`tokens` with ids_crc32, of its ids as little-endian unsigned 32-bit integers, in place of the ids."""
    kept = [f for f in tokens.schema.fields if f.name not in ("ids", "ids_crc32")]
    names = [f.name for f in kept]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", ids_crc32 long"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(values[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    return tokens.mapInArrow(tidy(part), schema)
