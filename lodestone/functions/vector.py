"""Vector functions over arrays of numbers, as higher-order column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, guard: str = "zero") -> Column:
    """guard: 'zero' (a zero vector gives 0), 'eps' (1e-8 is added to the denominator) or 'none' (null for a zero vector)."""
    bottom = norm(a) * norm(b)
    if guard == "eps":
        return dot(a, b) / (bottom + F.lit(1e-8))
    ratio = F.try_divide(dot(a, b), bottom)
    return F.coalesce(ratio, F.lit(0.0)) if guard == "zero" else ratio


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalize(a: Column) -> Column:
    """To unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def max_sim(query: Column, doc: Column) -> Column:
    """Sum over query vectors of the greatest dot product with a document vector."""
    return _sum(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))))


def top_mean(scores: Column, k: int = 3) -> Column:
    """Mean of the k greatest scores (of all if fewer)."""
    best = F.slice(F.sort_array(scores, asc=False), 1, k)
    return F.try_divide(_sum(best), F.size(best))


def pool(vectors: Column, how: str = "mean") -> Column:
    """One vector of several: mean, max, first or last."""
    if how == "first":
        return F.get(vectors, F.lit(0))
    if how == "last":
        return F.element_at(vectors, -1)
    size = F.size(F.get(vectors, F.lit(0)))
    at = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(vectors, lambda v: F.get(v, i).cast("double")))
    return F.transform(at, (lambda xs: _sum(xs) / F.size(xs)) if how == "mean" else F.array_max)
