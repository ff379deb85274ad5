"""Toxicity by class-conditional Kneser-Ney models.

The models run over the lower-cased bytes of words; a byte's context are up to ORDER - 1 bytes before it, not beyond
its word. One Kneser-Ney model is built of the counts of both classes together, each order backing off to the next by
how many different bytes precede. The model of a class discounts its own counts and gives what it took to that shared
distribution: an expression is evidence only as far as one class has often had the chance to use it and did or didn't,
and rare expressions fall back to shared counts alike in both. The log-likelihood ratio of every byte is tabled for all
n-grams that either class knows. A text is judged by its length-normalised ratio and by that of its most toxic word; a
logistic function of the two and of its length, fitted on sampled documents that the models haven't seen, makes a score.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Workspace, ship
from .bpe import _Table
from .common import LOWER, buffers, lean, pieces
from .labelled import every, remainder, sample

ORDER, SPAN, DISCOUNT, CLIP = 6, 40, 0.75, 8.0
_FOLD = LOWER.copy()
_FOLD[[9, 10, 11, 12, 13]] = 32


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte the ORDER bytes of its word that end there as a number (spaces before its word); offsets of the texts; where words begin."""
    data, off = buffers(texts)
    data = _FOLD[data]
    n = len(data)
    opens = np.zeros(n + 1, bool)
    opens[1:] = data == 32
    opens[off] = True
    begin = np.flatnonzero(opens[:-1])
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    key = data.astype(np.int64)
    for back in range(1, ORDER):
        x = np.full(n, 32, np.int64)
        x[back:] = data[: max(n - back, 0)]
        x[place < back] = 32
        key |= x << 8 * back
    return key, off, begin


def count_grams(rows: DataFrame) -> DataFrame:
    """gram, and how often each class (y) has it: n0, n1. Counts are summed in each slice before they are shuffled."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                key, off, _ = grams(part.column("text"))
                y = np.repeat(part.column("y").to_numpy(zero_copy_only=False), np.diff(off))
                own, back = np.unique(key, return_inverse=True)
                n1 = np.bincount(back, y, len(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(back, minlength=len(own)) - n1), pa.array(n1)], names=["gram", "n0", "n1"])

    made = rows.select("y", "text").mapInArrow(run, "gram long, n0 long, n1 long")
    return made.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, back = np.unique(keys, return_inverse=True)
    return own, np.bincount(back, values, len(own))


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def _discounted(context: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of n-grams in their contexts; a context without counts leaves the lower one."""
    ctx, total = _sums(context, counts)
    _, kinds = _sums(context, (counts > 0).astype(float))
    at, _ = _at(ctx, context)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds[at] * lower) / total[at]
    return np.where(total[at] > 0, p, lower)


class Models:
    """Ratios log P(byte | context, toxic) - log P(byte | context, ordinary) by longest known n-gram."""

    def __init__(self, gram: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        order = np.argsort(gram)
        gram, n0, n1 = gram[order], n0[order].astype(float), n1[order].astype(float)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # order, its n-grams, their ratios
        self._shared = None
        if not len(gram) or not n0.any() or not n1.any():
            return
        # Distinct n-grams of each order, with how many bytes precede them (for the highest: occurrences).
        levels = {ORDER: (gram, [n0, n1])}
        keys, have = gram, [n0 > 0, n1 > 0]
        for k in range(ORDER - 1, 0, -1):
            low = keys & ((1 << 8 * k) - 1)
            own, back = np.unique(low, return_inverse=True)
            levels[k] = (own, [np.bincount(back, h.astype(float), len(own)) for h in have])
            keys, have = own, [x > 0 for x in levels[k][1]]
        shared, below = np.zeros(0), np.zeros(0, np.int64)
        for k in range(1, ORDER + 1):
            keys, counts = levels[k]
            context = keys >> 8
            if k == 1:
                lower = np.full(len(keys), 1 / 256)
            else:
                at, _ = _at(below, keys & ((1 << 8 * (k - 1)) - 1))
                lower = shared[at]
            shared = _discounted(context, counts[0] + counts[1], lower)
            below = keys
            if k >= 3:
                p0, p1 = (_discounted(context, x, shared) for x in counts)
                ratio = np.clip(np.log(np.maximum(p1, 1e-12)) - np.log(np.maximum(p0, 1e-12)), -CLIP, CLIP)
                self.levels.insert(0, (k, keys, ratio.astype(np.float32)))

    def __getstate__(self) -> dict:
        return {"levels": self.levels}  # 12 bytes an n-gram; what looks them up is built where it is used

    def __setstate__(self, state: dict) -> None:
        self.levels, self._shared = state["levels"], None

    @functools.cached_property
    def tables(self) -> list[tuple[int, _Table, np.ndarray]]:
        return [(k, _Table(keys, np.arange(len(keys), dtype=np.int32)), ratio) for k, keys, ratio in self.levels]

    def broadcast(self, spark: SparkSession):
        """The models on every executor, sent once."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(self)
        return self._shared

    def ratios(self, key: np.ndarray) -> np.ndarray:
        """Of each byte; 0 where no n-gram of three bytes or more is known."""
        out = np.zeros(len(key), np.float32)
        left = np.arange(len(key))
        for k, table, ratio in self.tables:
            got = table.get(key[left] & ((1 << 8 * k) - 1))
            hit = got >= 0
            out[left[hit]] = ratio[got[hit]]
            left = left[~hit]
        return out

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Per text: mean ratio times SPAN, the ratio of its most toxic word, and the logarithm of its length in words, as long texts find a higher maximum by chance."""
        key, off, begin = grams(texts)
        ratio = self.ratios(key).astype(np.float64)
        total = np.concatenate(([0.0], np.cumsum(ratio)))
        n = np.diff(off)
        out = np.zeros((len(n), 3))
        full = np.flatnonzero(n)
        if len(full):
            out[full, 0] = SPAN * (total[off[1:]] - total[off[:-1]])[full] / n[full]
            word = np.clip(np.diff(total[np.append(begin, len(key))]), -CLIP, 2 * CLIP)
            first = np.searchsorted(begin, off)
            out[full, 1] = np.maximum.reduceat(word, first[:-1][full])
            out[:, 2] = np.log1p(np.diff(first))
        return out


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic function of x (last: intercept); classes count alike, a small penalty keeps it finite."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        return w
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + 0.5 * np.append(w[:-1], 0)
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 0.5 * np.diag([*np.ones(len(w) - 1), 1e-9])
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 8000, folds: int = 3, held: int = 1) -> tuple[Models, np.ndarray]:
    """Models of all labelled documents whose remainder isn't `held`, but for one in five of them, and weights from those.

    n-grams of all counted documents are kept, also those seen once, so the models grow with the distinct n-grams
    inside labelled words. The weights are fitted on at most `most` documents of either class that the models haven't seen.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "toxicity")
    allowed = remainder("doc_id", folds) != held
    apart = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(17)), F.lit(5)) == 0
    found = count_grams(every(docs, labels, label, allowed & ~apart)).toArrow()
    gram, n0, n1 = (found.column(c).to_numpy() for c in ("gram", "n0", "n1"))
    models = Models(gram, n0, n1)
    rows = work.table("sample", sample(docs, labels, label, most, allowed & apart))
    seen = _evidence(rows.select("y", "text"), models, "text").select("y", "mean", "peak", "length").toArrow()
    work.drop("sample")
    y = seen.column("y").to_numpy()
    return models, fit(np.column_stack([seen.column(c).to_numpy() for c in ("mean", "peak", "length")]), y)


def _evidence(docs: DataFrame, models: Models, text: str, weights: np.ndarray | None = None, threshold: float = 0.7) -> DataFrame:
    spark = docs.sparkSession
    shared = models.broadcast(spark)
    new = ["mean", "peak", "length"] if weights is None else ["score", "predicted"]
    kinds = [T.DoubleType()] * 3 if weights is None else [T.DoubleType(), T.IntegerType()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in pieces(batch, text):
                found = known.evidence(part.column(text))
                made = [pa.array(found[:, i].copy()) for i in range(3)]
                if weights is not None:
                    p = 1 / (1 + np.exp(-np.clip(found @ weights[:-1] + weights[-1], -30, 30)))
                    made = [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *new])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))]))


def score(docs: DataFrame, models: Models, weights: np.ndarray, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The given columns with score double (0 to 1) and predicted int; null and empty texts have no evidence either way.

    Input columns named as the new ones are replaced. The models are broadcast; they grow with the distinct n-grams of the labelled words.
    """
    ship(docs.sparkSession)
    return _evidence(docs.drop("score", "predicted"), models, text, weights, threshold)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7, most: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null id isn't held out.

    Rows that repeat are scored apart, equal texts alike; null and empty texts get a score without evidence, very long
    ones are taken whole; an empty table gives no rows and no labels (or one class only) leave every score at its
    neutral value. Other columns are ignored whatever their names.
    """
    models, weights = train(docs, labels, label, most, folds, held)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, models, weights, threshold=threshold).drop("text")
