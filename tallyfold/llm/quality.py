"""Operator 5: a quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a text labelled 1 beats a text labelled 0) give weights by logistic loss on the
differences of their features; a text's strength is its weighted feature sum. The threshold is a
quantile of the strengths of the training texts: the one that cuts off as large a share as has
label 0. Scores are strengths through a logistic curve that puts this threshold at 0.7.

Features come from the text alone (shares of byte classes and of their pairs, lengths, repetition).
The fit takes at most SAMPLE labelled rows, those of the smallest hashes of their ids; every text
is scored.

Defined results: null and empty texts are scored by their (zero) features; a null id is no held-out
row and has no label; labels other than 0 and 1 are ignored, of several labels of a document the
larger counts, of several texts under one labelled id the one with the least features is learnt from; without a pair (no labels, or one class) every score is 0.7; repeated rows stay as
they are; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import by_text, map_texts, table

#: The most labelled rows that the fit sees, and the preference pairs drawn from them.
SAMPLE, PAIRS = 20_000, 120_000
THRESHOLD = 0.7

#: Byte classes, by their bytes; 15 holds the rest.
CLASSES = [b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".", b",", b"!?", b"|", b"%$#&*", b"\"'`", b"()[]{}<>", b"/\\", b"-_+=~^:;@", bytes(range(128, 256))]
_CLASS = np.full(256, 15, np.uint8)
for _k, _bytes in enumerate(CLASSES):
    _CLASS[list(_bytes)] = _k
WIDTH = 16 + 256 + 7


def features(text: str) -> np.ndarray:
    """The feature vector of one whole text; zeros for an empty one."""
    out = np.zeros(WIDTH, np.float32)
    data = text.encode()
    if not data:
        return out
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    out[:16] = np.bincount(kinds, minlength=16) / len(kinds)
    if len(kinds) > 1:
        out[16:272] = np.bincount(kinds[:-1] * np.uint8(16) + kinds[1:], minlength=256) / (len(kinds) - 1)
    words, lines = data.split(), data.split(b"\n")
    n = max(1, len(words))
    out[272:] = (
        math.log1p(len(data)),
        math.log1p(len(words)),
        min(20.0, len(data) / n),
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        math.log1p(len(data) / len(lines)),
        math.log1p(len(lines)),
    )
    return out


class Model:
    """Weights over standardised features, with the threshold and the slope of the curve."""

    def __init__(self, weights: np.ndarray | None = None, center: np.ndarray | None = None, cut: float = 0.0, slope: float = 1.0):
        self.weights, self.center, self.cut, self.slope = weights, center, cut, slope

    def score(self, x: np.ndarray) -> np.ndarray:
        at = math.log(THRESHOLD / (1 - THRESHOLD))
        if self.weights is None:
            return np.full(len(x), THRESHOLD)
        z = self.slope * ((x - self.center) @ self.weights - self.cut) + at
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, steps: int = 600, seed: int = 7) -> Model:
    """Bradley-Terry by logistic loss on feature differences of (1, 0) pairs; deterministic."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model()
    rng = np.random.default_rng(seed)
    center, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = np.inf  # a constant feature says nothing
    z = np.clip((x - center) / scale, -8, 8).astype(np.float32)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        part = rng.integers(0, pairs, 2048)
        d = z[a[part]] - z[b[part]]
        grad = -d.T @ (1 / (1 + np.exp(np.clip(d @ w, -40, 40)))) / len(part) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.03 * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    strength = np.clip((x - center) / scale, -1e9, 1e9) @ w
    # between the largest strength of the share cut off and the next one
    s = np.sort(strength)
    k = len(bad)
    cut = float((s[k - 1] + s[min(k, len(s) - 1)]) / 2)
    slopes = [0.1, 0.2, 0.5, 1.0, 2.0, 4.0]
    at = math.log(THRESHOLD / (1 - THRESHOLD))
    loss = [np.mean(np.logaddexp(0, -(2 * y - 1) * (q * (strength - cut) + at))) for q in slopes]
    return Model((w / scale).astype(np.float64), center.astype(np.float64), cut, slopes[int(np.argmin(loss))])


def _matrix(texts: list[str]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, WIDTH), np.float32)


def held_out(id_col: str):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on the labelled rows that aren't held out, at most `sample` of them."""
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .where(~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    chosen = texts.join(F.broadcast(known), "_id")  # at most `sample` rows of two numbers

    def make():
        def work(batch: list[str]) -> dict:
            x = _matrix(batch)
            return {"x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))}

        return work

    # one row for each id, however many rows share it: at most `sample` rows reach the driver
    each = map_texts(chosen, "_t", {"_id": "_id", "_y": "_y"}, "x array<float>", make).groupBy("_id", "_y").agg(F.min("x").alias("x"))
    got = each.toArrow().sort_by("_id")
    if not got.num_rows:
        return Model()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
    return fit(x, got.column("_y").to_numpy())


def score_of(model: Model):
    """A column function: the score of a text column."""

    def make():
        return lambda texts: pa.array(model.score(_matrix(texts).astype(np.float64)), pa.float64())

    return by_text(make, "double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score for every row; one pass, no shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score_of(model)(F.col(text_col)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
