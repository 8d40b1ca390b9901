"""Interpolated Kneser-Ney models over the characters of words, one distribution per class.

Words are cut at white space and at whatever is no letter; each is padded with
blanks, so that its first letter is predicted from a word start and its end is
predicted too.  A model holds, per order, the sorted 64-bit hashes of its
n-grams with their interpolated log probabilities per class, and the sorted
hashes of its contexts with their backoff weights: looking up is a binary
search, and every class shares the search.

Counting runs over every training row: each partition counts the n-grams of its
distinct words, weighted by how often they occur, and ships one row per n-gram
and class.  No n-gram is left out at any size.  Where they take more than
BLOCK_CELLS, the model is held in blocks: what settles a prediction beyond the
letter's own frequency (n-grams, contexts, continuation counts) all shares the
character before the predicted one, so blocks are sets of such characters, built
one by one from discounts and letter counts that hold for the whole; texts then
meet the blocks by their distinct words.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import appended, bounded_batches, checkpointed, mix64, slices, tidy, unused

PAD = 32
#: Cells (n-gram types times classes) that a model holds in one block; about 16 bytes each.
BLOCK_CELLS = 4_000_000
#: Shares into which a word's row is dealt where texts are joined with words by a shuffle: some words are in every text.
SALTS = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row of each word, its index among the distinct ones, and the distinct words, lower-cased."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()))) if len(texts) else pa.array([], pa.list_(pa.large_string()))
    row = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    coded = split.flatten()
    coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


@dataclass
class Grams:
    """The padded characters of distinct words: windows end at `at`, of the word `word`."""

    chars: np.ndarray
    at: np.ndarray
    word: np.ndarray


def grams_of(words: list[str], order: int) -> Grams:
    """Positions to predict in `words`: each letter and the end of each run of letters."""
    pad = " " * (order - 1)
    chars = np.frombuffer((pad + pad.join(f" {w} " for w in words) + pad).encode("utf-32-le", "surrogatepass"), np.uint32).copy() if words else np.zeros(0, np.uint32)
    if not len(chars):
        return Grams(chars, np.zeros(0, np.int64), np.zeros(0, np.int64))
    # pad + ' ' + w + ' ' + pad + ' ' + ...: word k starts after k * (len(pad) + 2) + lengths before it
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = len(pad) + 1 + np.arange(len(words)) * (len(pad) + 2) + np.concatenate([[0], np.cumsum(lengths)[:-1]])
    letter = _letters()[np.minimum(chars, 0x10FFFF)]
    chars[~letter] = PAD
    at = np.flatnonzero(letter | np.concatenate([[False], letter[:-1]]))
    return Grams(chars, at, np.searchsorted(starts, at, side="right") - 1)


def hashes(chars: np.ndarray, at: np.ndarray, order: int, *, context: bool = False) -> list[np.ndarray]:
    """For k from 0 to `order`, the hash of the k characters that end at `at`.

    What lies before a word's first letter counts as blank: runs of letters
    never see each other, because whatever is no letter is a blank and a blank
    blocks all that comes before it.  A predicted blank is the end of a run and
    sees it; as part of a `context` it is what a run starts after, and blocks too.
    """
    out = [np.zeros(len(at), np.uint64)]
    open_ = np.ones(len(at), bool)
    for k in range(order):
        c = np.where(open_, chars[np.maximum(at - k, 0)], PAD).astype(np.uint64)
        if k or context:
            open_ &= c != PAD
        out.append(mix64(out[-1] * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64((k + 1) << 32)))
    return out


def windows(chars: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The characters themselves, a row of `order` for each position, in reading order."""
    cols, open_ = [], np.ones(len(at), bool)
    for k in range(order):
        c = np.where(open_, chars[np.maximum(at - k, 0)], PAD).astype(np.uint32)
        if k:
            open_ &= c != PAD
        cols.append(c)
    return np.stack(cols[::-1], axis=1) if cols else np.zeros((0, order), np.uint32)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a position of each, and the sums of their weights."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], order[first], np.add.reduceat(weights[order], first, axis=0) if len(keys) else weights


def count(df: DataFrame, text: str, label: str, classes: list[str], order: int) -> DataFrame:
    """n-grams of the highest order with a count per class: (gram, c0, c1, ...). Rows whose label is not in `classes` don't count."""
    k = len(classes)
    bounded_batches(df.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, sums = np.zeros(0, np.uint64), np.zeros((0, order), np.uint32), np.zeros((0, k), np.int64)
        for whole in batches:
            for b in slices(whole, "t"):
                label_of = pc.index_in(b.column("c"), value_set=pa.array(classes, pa.string()))
                row, word, words = words_of(b.column("t"))
                if not words:
                    continue
                cls = label_of.fill_null(-1).to_numpy(zero_copy_only=False)[row]
                often = np.stack([np.bincount(word[cls == j], minlength=len(words)) for j in range(k)], axis=1)
                g = grams_of(words, order)
                h = hashes(g.chars, g.at, order)[order]
                new, first, weight = _summed(h, often[g.word])
                fresh = windows(g.chars, g.at[first], order)
                both, first, sums = _summed(np.concatenate([keys, new]), np.concatenate([sums, weight]))
                rows, keys = np.concatenate([rows, fresh])[first], both
        for i in range(0, len(keys), 100_000):
            text_of = rows[i : i + 100_000].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            grams = [text_of[j : j + order] for j in range(0, len(text_of), order)]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *(pa.array(sums[i : i + 100_000, j]) for j in range(k))], ["gram", *(f"c{j}" for j in range(k))])

    schema = "gram string, " + ", ".join(f"c{j} long" for j in range(k))
    parts = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("string").alias("c")).mapInArrow(tidy(part), schema)
    return parts.groupBy("gram").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(k))).where(" or ".join(f"c{j} > 0" for j in range(k)))


@dataclass
class Model:
    """classes; per order k from 1: sorted n-gram hashes, log probabilities, sorted context hashes, log backoff weights.

    `own`: the characters whose successors this block predicts (None for all), and with `others` also those of whatever isn't in it.
    """

    classes: list[str]
    order: int
    own: np.ndarray | None = None
    others: np.ndarray | None = None
    uniform: float = 0.0
    types: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: summed log likelihood per class, and the number of predictions."""
        g = grams_of(words, self.order)
        if self.own is not None:
            before = g.chars[np.maximum(g.at - 1, 0)]
            mine = np.isin(before, self.own)
            if self.others is not None:
                mine |= ~np.isin(before, self.others)
            g = Grams(g.chars, g.at[mine], g.word[mine])
        h = hashes(g.chars, g.at, self.order)
        before = hashes(g.chars, np.maximum(g.at - 1, 0), self.order - 1, context=True)
        uniq, first, back = np.unique(h[self.order], return_index=True, return_inverse=True)
        del uniq
        ll = self._chain([x[first] for x in h], [x[first] for x in before])[back]
        out = np.zeros((len(words), len(self.classes)))
        for j in range(len(self.classes)):
            out[:, j] = np.bincount(g.word, ll[:, j], len(words)) if len(g.word) else 0
        return out, np.bincount(g.word, minlength=len(words)) if len(g.word) else np.zeros(len(words), np.int64)

    def _chain(self, h: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        n, out = len(h[0]), None
        out = np.full((n, len(self.classes)), self.uniform)
        weight = np.zeros((n, len(self.classes)))
        left = np.arange(n)
        for k in range(self.order, 0, -1):
            types, contexts = self.types[k - 1], self.contexts[k - 1]
            i = np.minimum(np.searchsorted(types, h[k][left]), max(len(types) - 1, 0))
            hit = types[i] == h[k][left] if len(types) else np.zeros(len(left), bool)
            out[left[hit]] = self.logp[k - 1][i[hit]] + weight[left[hit]]
            left = left[~hit]
            if not len(left):
                return out
            i = np.minimum(np.searchsorted(contexts, before[k - 1][left]), max(len(contexts) - 1, 0))
            known = contexts[i] == before[k - 1][left] if len(contexts) else np.zeros(len(left), bool)
            weight[left[known]] += self.backoff[k - 1][i[known]]
        out[left] = self.uniform + weight[left]
        return out


def _contexts(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the k characters before the last of each row, as `hashes` gives them for running text."""
    n = len(chars)
    flat = np.concatenate([np.full((n, 1), PAD, np.uint32), chars], axis=1).ravel()
    at = np.arange(n) * (order + 1) + order
    return hashes(flat, at, order), hashes(flat, at - 1, order - 1, context=True)


@dataclass
class Whole:
    """What a block needs to know of all n-grams: letters with their counts per class, and discounts by order and class."""

    letters: list[str]
    counts: np.ndarray
    discounts: dict[int, np.ndarray]


def build(grams: list[str], counts: np.ndarray, classes: list[str], order: int, *, shared: bool, whole: Whole | None = None) -> Model:
    """The model of n-gram counts [gram, class]. shared: continuation counts of lower orders are those of all classes together.

    With `whole`, the n-grams are those of a block, and letter counts and discounts are given.
    """
    model = Model(list(classes), order)
    chars = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order) if grams else np.zeros((0, order), np.uint32)
    h, ctx = _contexts(chars, order)
    k_cls = len(classes)
    levels = []
    present, rows = counts.astype(np.float64), np.arange(len(grams))
    for k in range(order, 0, -1):  # counts from the highest order down
        types, first, summed = _summed(h[k][rows], present)
        levels.append((k, types, ctx[k - 1][rows[first]], h[k - 1][rows[first]], summed))
        rows = rows[first]
        seen = summed > 0
        present = (np.repeat(seen.any(axis=1)[:, None], k_cls, axis=1) if shared else seen).astype(np.float64)
    if whole:
        letter = np.frombuffer("".join(whole.letters).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, 1)
        types, first, summed = _summed(_contexts(letter, 1)[0][1], whole.counts.astype(np.float64))
        levels[-1] = (1, types, np.zeros(len(types), np.uint64), np.zeros(len(types), np.uint64), summed)
    model.uniform = -float(np.log(max(2, len(levels[-1][1]) + 1)))
    lower, lower_types = None, None
    for k, types, context, suffix, c in reversed(levels):  # probabilities from the lowest up
        discount = whole.discounts[k] if whole else np.array([_discount((c[:, j] == 1).sum(), (c[:, j] == 2).sum()) for j in range(k_cls)])
        contexts, where = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(contexts), k_cls)), np.zeros((len(contexts), k_cls))
        for j in range(k_cls):
            total[:, j] = np.bincount(where, c[:, j], len(contexts))
            kinds[:, j] = np.bincount(where, c[:, j] > 0, len(contexts))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1e-300), 1.0)
        base = np.full((len(types), k_cls), np.exp(model.uniform)) if lower is None else lower[np.searchsorted(lower_types, suffix)]
        p = np.where(total[where] > 0, np.maximum(c - discount, 0) / np.maximum(total[where], 1e-300), 0) + weight[where] * base
        lower, lower_types = p, types
        model.types.append(types)
        model.logp.append(np.log(np.maximum(p, 1e-30)).astype(np.float32))
        model.contexts.append(contexts)
        model.backoff.append(np.log(np.maximum(weight, 1e-30)).astype(np.float32))
    return model


def _discount(n1: float, n2: float) -> float:
    """The absolute discount n1 / (n1 + 2 n2), within bounds that keep every probability positive."""
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5


def _whole(counts: DataFrame, k: int, order: int, *, shared: bool) -> Whole:
    """Discounts of every order and the letters' counts, from all n-grams: a row of sums per order, and the alphabet."""
    level, discounts = counts, {}
    for n in range(order, 0, -1):
        row = level.agg(*(F.count_if(F.col(f"c{j}") == v).alias(f"n{v}_{j}") for j in range(k) for v in (1, 2))).first()
        discounts[n] = np.array([_discount(row[f"n1_{j}"], row[f"n2_{j}"]) for j in range(k)])
        if n > 1:  # each distinct n-gram continues its last n - 1 characters once; all here have some count
            level = level.groupBy(F.substring("gram", 2, n - 1).alias("gram")).agg(*((F.count(F.lit(1)) if shared else F.count_if(F.col(f"c{j}") > 0)).alias(f"c{j}") for j in range(k)))
    rows = level.collect()
    return Whole([r["gram"] for r in rows], np.array([[r[f"c{j}"] for j in range(k)] for r in rows]), discounts)


def _packed(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Characters in blocks of `most` n-grams or so."""
    out, left = [], 0
    for c in sorted(sizes):
        if not out or sizes[c] > left:
            out.append([])
            left = most
        out[-1].append(c)
        left -= sizes[c]
    return out


def fit(df: DataFrame, text: str, label: str, classes: list[str], *, order: int, shared: bool, block_cells: int = BLOCK_CELLS) -> list[Model]:
    """Count over all of `df` and build the model, in blocks of `block_cells` or so (one character's at least)."""
    k = len(classes)
    if not k:
        return [build([], np.zeros((0, 0)), [], order, shared=shared)]
    counts = checkpointed(count(df, text, label, classes, order))
    before = F.substring("gram", order - 1, 1)
    sizes = {r["b"]: r["n"] for r in counts.groupBy(before.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # an alphabet
    blocks = _packed(sizes, max(1, block_cells // k))
    whole = _whole(counts, k, order, shared=shared) if len(blocks) > 1 else None
    models = []
    for own in blocks or [[]]:
        got = (counts.where(before.isin(own)) if whole else counts).toArrow()
        grams = got.column("gram").to_pylist()
        model = build(grams, np.stack([got.column(f"c{j}").to_numpy() for j in range(k)], axis=1).reshape(len(grams), k), classes, order, shared=shared, whole=whole)
        models.append(model)
        if whole:
            model.own = np.array([ord(c) for c in own], np.uint32)
    if whole:  # whatever no block has seen before a letter is the first one's to predict
        models[0].others = np.array(sorted(ord(c) for c in sizes), np.uint32)
    return models


def summed(df: DataFrame, text: str, models: list[Model], vector: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int, new: dict[str, str], finish: Callable[[pa.RecordBatch | None, np.ndarray], list[pa.Array]]) -> DataFrame:
    """`df` with the columns `new` that finish(batch, sums) makes of each text's sum of its words' vectors.

    vector(log likelihoods per class, predictions) gives `size` numbers a word.
    Null and word-less texts have sums of zero.  A model of one block goes to
    the workers and texts stay where they are; with more blocks, distinct words
    meet each block, and texts' words are joined with the sums.
    """
    spark = df.sparkSession

    def words(texts: pa.Array, of: Callable[[list[str]], np.ndarray]) -> np.ndarray:
        row, word, distinct = words_of(pc.fill_null(texts, ""))
        if not distinct:
            return np.zeros((len(texts), size))
        v = of(distinct)
        return np.stack([np.bincount(row, v[word, i], len(texts)) for i in range(size)], axis=1) if size else np.zeros((len(texts), 0))

    if len(models) == 1:
        share = spark.sparkContext.broadcast(models[0])
        return appended(df, text, new, lambda b: finish(b, words(b.column(text), lambda w: vector(*share.value.score(w)))))
    k = len(models[0].classes)
    key, sums = unused(df, "text_key"), unused(df, "text_sums")
    digest = F.md5(F.col(text)).alias(key)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "t"):
                row, word, distinct = words_of(b.column("t"))
                both, n = np.unique(row.astype(np.int64) * len(distinct) + word, return_counts=True) if distinct else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                at = pa.array(both // max(1, len(distinct)))
                yield pa.RecordBatch.from_arrays([b.column("d").take(at), pa.array(distinct, pa.string()).take(pa.array(both % max(1, len(distinct)))), pa.array(n)], ["d", "word", "n"])

    bounded_batches(spark)
    held = df.select(digest.alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInArrow(tidy(pairs), "d string, word string, n long")
    held = checkpointed(held.groupBy("d", "word").agg(F.max("n").alias("n")))  # equal texts once
    distinct, parts = checkpointed(held.select("word").distinct()), None
    columns = [f"l{j}" for j in range(k)]
    for model in models:
        share = spark.sparkContext.broadcast(model)

        def score(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ll, n = share.value.score(b.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("word"), *(pa.array(np.ascontiguousarray(c)) for c in ll.T), pa.array(n.astype(np.int64))], ["word", *columns, "n"])

        got = distinct.mapInArrow(tidy(score), ", ".join(["word string", *(f"{c} double" for c in columns), "n long"]))
        parts = got if parts is None else parts.unionByName(got)
        parts = checkpointed(parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in [*columns, "n"])))
    names = [f"v{i}" for i in range(size)]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ll = np.stack([b.column(c).to_numpy() for c in columns], axis=1)
            v = vector(ll, b.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("word"), *(pa.array(np.ascontiguousarray(c)) for c in v.T)], ["word", *names])

    known = parts.mapInArrow(tidy(vectors), ", ".join(["word string", *(f"{c} double" for c in names)])).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int"))
    of = salted.join(known, ["word", "salt"]).groupBy("d").agg(F.array(*(F.sum(F.col("n") * F.col(c)) for c in names)).alias(sums)).withColumnRenamed("d", key)
    joined = df.withColumn(key, F.md5(F.col(text))).join(of, key, "left").withColumn(sums, F.coalesce(sums, F.array(*(F.lit(0.0) for _ in names)))).drop(key)
    flat = lambda b: np.asarray(b.column(sums).flatten().to_numpy()).reshape(-1, size)
    return appended(joined, text, new, lambda b: finish(b, flat(b))).drop(sums)
