"""Keyword and threshold rules as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

# Keyword lists of the routing rules.
FACTUAL = ("what is", "who is", "when was", "where is")
COMPLEX = ("how do", "how can", "why does", "explain", "describe")
GREETINGS = ("hi", "hello", "hey", "good morning", "good afternoon", "good evening")
PROCEDURAL = ("how to", "how do", "how can")
COMPARING = ("compare", "difference", "versus", " vs ")
ANALYSING = ("why", "explain", "analyze")
QUESTION_WORDS = ("what", "how", "why", "when", "where", "who")
COMPARISON_WORDS = ("compare", "difference", "versus", "vs")
TEMPORAL_WORDS = ("latest", "recent", "current", "new")


def _any(test, values) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(v)
    return out


def use_hypothetical(query: Column) -> Column:
    """Whether a query gains from a hypothetical answer: not if short or factual, if it asks how or why, or is long."""
    q, n = F.lower(query), F.size(words(query))
    return F.when(n <= 3, False).when(_any(q.startswith, FACTUAL), False).when(_any(q.startswith, COMPLEX), True).otherwise(n > 5)


# Words that ask about a whole collection.
GLOBAL_WORDS = ("overall", "summary", "summarize", "main themes", "in general")


def scope(query: Column, long: int = 60) -> Column:
    """global for questions about the whole collection (by keyword, or longer than `long` words), else local."""
    return F.when(_any(F.lower(query).contains, GLOBAL_WORDS) | (F.size(words(query)) > long), "global").otherwise("local")


def route(query: Column) -> Column:
    """struct(type, strategy, top_k, confidence) by keywords."""
    q = F.lower(query)
    greet = _any(lambda g: F.trim(q) == g, GREETINGS) | _any(lambda g: F.trim(q).startswith(g), ("hi ", "hello ", "hey "))
    has = lambda values: _any(lambda v: q.contains(v), values)

    def pick(*values) -> Column:
        return F.when(greet, values[0]).when(has(PROCEDURAL), values[1]).when(has(COMPARING), values[2]).when(has(ANALYSING), values[3]).otherwise(values[4])

    return F.struct(
        pick("conversational", "procedural", "comparison", "analytical", "factual").alias("type"),
        pick("none", "direct", "multi_query", "hyde", "direct").alias("strategy"),
        pick(0, 10, 15, 12, 10).alias("top_k"),
        pick(1.0, 0.6, 0.6, 0.6, 0.5).alias("confidence"),
    )


def query_features(query: Column) -> Column:
    w = words(F.lower(query))
    has = lambda values: F.arrays_overlap(w, F.array(*map(F.lit, values)))
    return F.struct(F.size(w).alias("length"), has(QUESTION_WORDS).alias("question"), has(COMPARISON_WORDS).alias("comparison"), has(TEMPORAL_WORDS).alias("temporal"))


def feature_similarity(a: Column, b: Column) -> Column:
    return sum(((a[k] == b[k]).cast("int") for k in ("length", "question", "comparison", "temporal")), F.lit(0)) / 4


def relevant(overlap: Column) -> Column:
    return overlap > 0.3


def overlap_score(overlap: Column) -> Column:
    return F.least(overlap * 2, F.lit(1.0))


# The thresholds of the grades below.
def retrieval_quality(ratio: Column, mean: Column) -> Column:
    return F.when((ratio >= 0.7) & (mean >= 0.7), "excellent").when((ratio >= 0.5) | (mean >= 0.5), "good").when((ratio >= 0.3) | (mean >= 0.3), "partial").otherwise("poor")


def correction(quality: Column) -> Column:
    return F.when(quality.isin("excellent", "good"), "proceed").when(quality == "partial", "expand_search").otherwise("refine_query")


def support_token(score: Column) -> Column:
    return F.when(score >= 0.7, "fully").when(score >= 0.4, "partially").otherwise("not")


def crag_level(score: Column) -> Column:
    return F.when(score >= 0.8, "correct").when(score >= 0.4, "ambiguous").otherwise("incorrect")


def confidence(sources: Column) -> Column:
    return F.least(sources / 5, F.lit(1.0)) * 0.8


def backoff_seconds(attempt: Column, base: float = 1.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """min(base * 2**attempt, most), times a factor drawn from .5 to 1.5 if one is given."""
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
    return wait * jitter if jitter is not None else wait


def suggestions(support: Column, relevance: Column, utility: Column) -> Column:
    """Advice where a score is below .5."""
    return F.concat_ws(
        " ",
        F.when(relevance < 0.5, "Retrieve more relevant context."),
        F.when(support < 0.5, "Ground the answer in the sources."),
        F.when(utility < 0.5, "Answer the question more directly."),
    )
