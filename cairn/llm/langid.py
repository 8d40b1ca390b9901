"""Language identification with interpolated Kneser-Ney character models.

One model per language, all in the same sorted hash arrays; a text gets the
language under which its cross-entropy per predicted character is lowest.

It is rejected if that entropy is far above what the language's own texts show.
The bound is calibrated on texts that the models have not counted, one in ASIDE
by a hash: the median of their entropies, and TIMES the excess over it that all
but one in ODDS of them keep within.  Excesses are scaled by length, as short
texts scatter more.  A language with fewer than LEAST such texts takes the
bound of all languages' texts together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import kneser_ney
from cairn.llm.common import checkpointed, unused

ORDER = 4
UNKNOWN = "und"
#: One training text in so many is set aside for the bounds; such texts from which on a language, or the corpus, has a bound.
ASIDE, LEAST = 8, 20
#: Of set-aside texts one in ODDS exceeds the quantile that TIMES multiplies; the least excess that rejects; the length at which excesses double.
ODDS, TIMES, FLOOR, SHORT = 1000, 3.0, 0.25, 40
#: Sharpness of the score, in predicted characters.
SHARPNESS = 12.0


@dataclass
class Identifier:
    models: list[kneser_ney.Model]
    classes: list[str]
    middle: np.ndarray
    excess: np.ndarray

    def decided(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text, from its sums: whether it has a language at all, the best one, the score, and whether it is rejected."""
        h, n = entropies(sums)
        if not self.classes:
            return np.zeros(len(n), bool), np.zeros(len(n), np.int64), np.zeros(len(n)), np.ones(len(n), bool)
        best = h.argmin(axis=1)
        low = h[np.arange(len(n)), best]
        some = n > 0
        score = np.where(some, 1 / np.exp(-SHARPNESS * (h - low[:, None])).sum(axis=1), 0.0)
        return some, best, score, ~some | (low > self.middle[best] + self.excess[best] * (1 + SHORT / np.maximum(n, 1)))


def _vector(ll: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.concatenate([ll, many[:, None]], axis=1)


def entropies(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: nats per predicted character under each language, and the number of predictions."""
    n = sums[:, -1]
    return -sums[:, :-1] / np.maximum(n, 1)[:, None], n


def fit(df: DataFrame, text: str, lang: str, *, order: int = ORDER, block_cells: int = kneser_ney.BLOCK_CELLS) -> Identifier:
    """Models and bounds from every row of `df` with a text and a language; the languages are those that occur."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    aside = F.pmod(F.xxhash64(F.lit(5), F.col("text")), F.lit(ASIDE)) == 0
    classes = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    models = kneser_ney.fit(rows.where(~aside), "text", "lang", classes, order=order, shared=False, block_cells=block_cells)
    k = len(classes)
    middle, excess = np.full(k, np.inf), np.full(k, np.inf)
    if k:

        def own(b: pa.RecordBatch, sums: np.ndarray) -> list[pa.Array]:
            h, n = entropies(sums)
            j = pc.index_in(b.column("lang"), value_set=pa.array(classes)).to_numpy(zero_copy_only=False)
            return [pa.array(np.where((h.argmin(axis=1) == j) & (n > 0), h[np.arange(len(j)), j], np.nan)), pa.array(n)]

        seen = kneser_ney.summed(rows.where(aside), "text", models, _vector, k + 1, {"h": "double", "n": "double"}, own).where("not isnan(h)")
        seen = checkpointed(seen.select("lang", "h", "n"))
        quantiles = {}
        for each in ("lang", F.lit(None).cast("string")):
            by = seen.withColumn("lang", each) if not isinstance(each, str) else seen
            middles = by.groupBy("lang").agg(F.percentile_approx("h", F.lit(0.5), F.lit(10_000)).alias("m"))
            over = by.alias("s").join(F.broadcast(middles).alias("m"), F.col("s.lang").eqNullSafe(F.col("m.lang")))  # a row a language
            over = over.select("s.lang", "m", ((F.col("h") - F.col("m")) / (1 + F.lit(float(SHORT)) / F.col("n"))).alias("e"))
            found = over.groupBy("lang").agg(F.first("m").alias("m"), F.percentile_approx("e", F.lit(1 - 1 / ODDS), F.lit(10 * ODDS)).alias("e"), F.count("e").alias("n")).collect()
            quantiles |= {r["lang"]: (r["m"], max(FLOOR, TIMES * r["e"])) for r in found if r["n"] >= LEAST}
        for j, c in enumerate(classes):
            middle[j], excess[j] = quantiles.get(c, quantiles.get(None, (np.inf, np.inf)))
    return Identifier(models, classes, middle, excess)


def known(df: DataFrame, text: str, fitted: Identifier) -> DataFrame:
    """The rows of `df` that `identify` doesn't reject."""
    gone, size = unused(df, "gone"), len(fitted.classes) + 1
    return kneser_ney.summed(df, text, fitted.models, _vector, size, {gone: "boolean"}, lambda _, sums: [pa.array(fitted.decided(sums)[3])]).where(~F.col(gone)).drop(gone)


def identify(df: DataFrame, text: str, fitted: Identifier) -> DataFrame:
    """`df` with lang_pred, score (0 to 1) and rejected.

    A null text, one without a letter, or any text where no language was
    learned is `und` with score 0, and rejected.  Ties go to the language that
    sorts first.  Repeated rows are kept; columns named like the new ones are
    replaced.
    """
    names = np.array([*fitted.classes, UNKNOWN], dtype=object)

    def finish(_, sums: np.ndarray) -> list[pa.Array]:
        some, best, score, rejected = fitted.decided(sums)
        return [pa.array(names[np.where(some, best, len(names) - 1)], pa.string()), pa.array(score), pa.array(rejected)]

    return kneser_ney.summed(df, text, fitted.models, _vector, len(fitted.classes) + 1, {"lang_pred": "string", "score": "double", "rejected": "boolean"}, finish)
