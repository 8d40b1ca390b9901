"""Toxicity scores from class-conditional Kneser-Ney models.

A toxic and an ordinary model of the characters of words share their backoff
counts, so an expression too rare to tell the classes apart gets the same
probability from both.  The text's log-likelihoods under both are compared per
word: the ratio itself, and what is left of each word's ratio beyond dead zones
that take out what only the mix of languages or topics brings.  A logistic
curve over these length-normalised ratios turns them into a score.

Counts come from every labelled training row but those that a hash of the text
sets aside for the curve: one in CALIBRATION, or fewer where these are more than
MAX_CALIBRATION.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import kneser_ney

ORDER = 5
#: Dead zones, in nats, of a word's log-likelihood ratio; zero: the plain ratio.
ZONES = (0.0, 1.5, 3.0, 5.0)
CALIBRATION = 4
MAX_CALIBRATION = 20_000


@dataclass
class Curve:
    """Logistic regression over the normalised ratios; `rate` alone where it can't be fitted."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    rate: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.rate)
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _vector(ll: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of each word, one, and its ratio beyond each dead zone."""
    ratio = ll[:, 1] - ll[:, 0]
    beyond = [np.sign(ratio) * np.maximum(np.abs(ratio) - zone, 0) for zone in ZONES]
    return np.stack([np.ones(len(ratio)), *beyond], axis=1)


def features(sums: np.ndarray) -> np.ndarray:
    """Per text: for each dead zone, the word ratios beyond it per word. No word: zeros."""
    return sums[:, 1:] / np.maximum(sums[:, :1], 1)


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> Curve:
    """The curve over rows x that stand for `n` texts each, with labels y."""
    many = max(1.0, float(n.sum()))
    rate = float((y * n).sum()) / many
    mean = (x * n[:, None]).sum(axis=0) / many
    scale = np.sqrt(((x - mean) ** 2 * n[:, None]).sum(axis=0) / many) + 1e-9
    if many < 8 or rate in (0.0, 1.0):
        return Curve(mean, scale, None, rate)
    a = np.concatenate([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)], axis=1)
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [1e-2] * (a.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (n * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return Curve(mean, scale, w, rate)


def fit(df: DataFrame, text: str, label: str, *, order: int = ORDER, block_cells: int = kneser_ney.BLOCK_CELLS, max_calibration: int = MAX_CALIBRATION) -> tuple[list[kneser_ney.Model], Curve]:
    """Models and curve from the rows of `df` whose `label` is 0 or 1; others, and null texts, teach nothing."""
    rows = df.select(F.col(text).alias("text"), F.col(label).cast("int").cast("string").alias("label")).where("text is not null and label in ('0', '1')")
    share = min(1 / CALIBRATION, max_calibration / max(1, rows.count()))
    aside = F.pmod(F.xxhash64(F.lit(3), F.col("text")), F.lit(1_000_000)) < F.lit(int(1_000_000 * share))
    models = kneser_ney.fit(rows.where(~aside), "text", "label", ["0", "1"], order=order, shared=True, block_cells=block_cells)
    zones = [f"f{j}" for j in range(len(ZONES))]
    held = kneser_ney.summed(rows.where(aside), "text", models, _vector, 1 + len(ZONES), dict.fromkeys(zones, "double"), lambda _, sums: [pa.array(np.ascontiguousarray(c)) for c in features(sums).T])
    got = held.groupBy("label", *zones).agg(F.count(F.lit(1)).cast("double").alias("n")).toArrow()  # copies of a text are one row
    y = np.array([int(v) for v in got.column("label").to_pylist()], float)
    return models, _curve(np.stack([got.column(c).to_numpy() for c in zones], axis=1), y, got.column("n").to_numpy())


def score(df: DataFrame, text: str, fitted: tuple[list[kneser_ney.Model], Curve]) -> DataFrame:
    """`df` with score (0 to 1, higher: likelier toxic) and predicted (1 from a half on).

    Texts are scored whole; a null text counts as empty, and a text without a
    word gets the score of ratios at zero.  Repeated rows are kept, each with
    its score; columns named like the new ones are replaced.
    """
    models, curve = fitted

    def finish(_, sums: np.ndarray) -> list[pa.Array]:
        s = curve(features(sums))
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return kneser_ney.summed(df, text, models, _vector, 1 + len(ZONES), {"score": "double", "predicted": "int"}, finish)
