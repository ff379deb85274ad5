"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are word unigrams and bigrams and, so that unseen words count as well, n-grams of word shapes (which kinds of
bytes a word has, how long it is, how it ends, whether it repeats the word before). Each is hashed into one table of
weights; a feature's value is its share of the text's words. A score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import U64, Words, lean, mix, pieces
from .labelled import remainder, sample

BITS = 18
SCALE = 8.0
_KIND = np.full(256, 16, np.uint8)
_KIND[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8


def features(words: Words) -> list[np.ndarray]:
    """Per family of features the weight index of each word's feature."""
    n = len(words)
    if not n:
        return [np.zeros(0, np.int64)] * 4
    h = words.hashes()
    opens = np.zeros(n, bool)
    opens[words.first[:-1][np.diff(words.first) > 0]] = True
    prev = np.concatenate((h[:1], h[:-1]))
    prev[opens] = 0
    kinds = np.bitwise_or.reduceat(_KIND[words.data], words.begin).astype(U64)
    size = np.minimum(np.log2(words.end - words.begin).astype(U64), U64(7))
    last = words.data[words.end - 1]
    tail = np.where(_KIND[last] == 16, last, _KIND[last]).astype(U64)
    shape = kinds | size << U64(5) | tail << U64(8) | (h == prev).astype(U64) << U64(16)
    before = np.concatenate((shape[:1], shape[:-1]))
    before[opens] = U64(1 << 20)
    two = np.concatenate((before[:1], before[:-1]))
    two[opens] = U64(1 << 20)
    out = [h, h + prev * U64(0x9E3779B97F4A7C15), shape | U64(1 << 40), mix(shape | before << U64(21) | two << U64(42))]
    return [(mix(x + U64(i)) >> U64(64 - BITS)).astype(np.int64) for i, x in enumerate(out)]


class Leader:
    """FTRL-proximal with per-coordinate rates and an L1 threshold."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = weight * (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _train(batches: Iterator[pa.RecordBatch], epochs: int) -> Iterator[pa.RecordBatch]:
    seen: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Words(part.column("text"))
            feats = features(words)
            for i, (key, y) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("y").to_pylist(), strict=True)):
                a, b = words.first[i], words.first[i + 1]
                at, n = np.unique(np.concatenate([f[a:b] for f in feats]), return_counts=True)
                seen.append((key, y, np.append(at, 1 << BITS).astype(np.int32), np.append(SCALE * n / max(b - a, 1), 1.0).astype(np.float32)))
    seen.sort(key=lambda r: (hash((r[0] * 0x9E3779B97F4A7C15) & 0xFFFFFFFF), r[0]))
    ones = sum(r[1] for r in seen)
    share = [len(seen) / (2 * max(len(seen) - ones, 1)), len(seen) / (2 * max(ones, 1))]
    leader = Leader()
    for _ in range(epochs):
        for _, y, at, x in seen:
            leader.learn(at, x, y, share[y])
    yield pa.RecordBatch.from_arrays([pa.array([leader.weights(slice(None)).astype(np.float32).tobytes()], pa.binary())], names=["w"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 5000, folds: int = 5, held: int = 0, epochs: int = 3) -> np.ndarray:
    """Weights learned from a bounded sample: at most `most` documents of either class whose crc32 remainder isn't `held`.

    One task trains on the sample, whatever the size of the tables. With no labelled rows all weights are 0.
    """
    ship(docs.sparkSession)
    rows = sample(docs, labels, label, most, remainder("doc_id", folds) != held)
    made = rows.repartition(1).mapInArrow(partial(_train, epochs=epochs), "w binary").first()
    return np.frombuffer(made["w"], np.float32).copy() if made else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The given columns with score double (0 to 1) and predicted int. Null and empty texts score by the intercept.

    Input columns named as the new ones are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("score", "predicted")
    shared = spark.sparkContext.broadcast(weights)  # 1 MB

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in pieces(batch, text):
                words = Words(part.column(text))
                total = np.zeros(len(words) + 1)
                np.cumsum(sum(w[f].astype(np.float64) for f in features(words)), out=total[1:])
                n = np.diff(words.first)
                dot = float(w[-1]) + SCALE * np.diff(total[words.first]) / np.maximum(n, 1)
                p = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3, most: int = 5000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null id isn't held out.

    Rows that repeat are scored apart, equal texts alike; null and empty texts get a score without evidence, very long
    ones are taken whole; an empty table gives no rows and no labels (or one class only) leave every score at its
    neutral value. Other columns are ignored whatever their names.
    """
    weights = train(docs, labels, label, most, folds, held)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, weights, threshold=threshold).drop("text")
