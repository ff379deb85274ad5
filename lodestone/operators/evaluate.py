"""Retrieval and answer metrics over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_metrics(hits: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row over all queries of `truth` (query_id, doc_id): hit rate, MRR, recall and NDCG at k of hits (query_id, doc_id, rank).

    Gains are binary; the ideal order has all true documents first.
    """
    good = hits.where(F.col("rank") <= k).join(truth, ["query_id", "doc_id"])
    per = good.groupBy("query_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("found"), F.sum(1 / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    all_ = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).withColumn("ideal", ideal)
    rows = all_.join(per, "query_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.col("first").isNotNull().cast("double")).alias("hit_rate"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce(F.col("found"), F.lit(0)) / F.col("n")).alias("recall"),
        F.avg(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
    )


def context_precision(rows: DataFrame) -> DataFrame:
    """Share of relevant contexts of each query (boolean column relevant)."""
    return rows.groupBy("query_id").agg(F.avg(F.col("relevant").cast("double")).alias("score"))


def claim_support(rows: DataFrame, empty: float = 1.0) -> DataFrame:
    """Faithfulness per query of claims (query_id, claim, verdict): supported share, counts of each verdict; a query whose
    claims are all null scores `empty`."""
    n = F.count("claim")
    of = lambda v: F.count_if((F.col("verdict") == v) & F.col("claim").isNotNull())
    return rows.groupBy("query_id").agg(
        F.when(n == 0, F.lit(empty)).otherwise(of("supported") / n).alias("score"), of("supported").alias("supported"), of("contradicted").alias("contradicted"), of("neutral").alias("neutral")
    )


def context_recall(rows: DataFrame) -> DataFrame:
    """Supported share of ground-truth claims; no truth gives 0, a truth without claims 1 (columns truth, claim, verdict)."""
    n = F.count("claim")
    return rows.groupBy("query_id").agg(F.when(F.max("truth").isNull(), 0.0).when(n == 0, 1.0).otherwise(F.count_if(F.col("verdict") == "supported") / n).alias("score"))


def answer_relevancy(rows: DataFrame) -> DataFrame:
    """The greatest similarity of generated questions to the query; .5 without any."""
    return rows.groupBy("query_id").agg(F.coalesce(F.max("similarity"), F.lit(0.5)).alias("score"))


def weighted(metrics: DataFrame, weights: dict[str, float], default: float) -> DataFrame:
    """Weighted mean of metrics (query_id, metric, score)."""
    w = F.lit(default)
    for name, value in weights.items():
        w = F.when(F.col("metric") == name, F.lit(value)).otherwise(w)
    return metrics.withColumn("w", w).groupBy("query_id").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("score"))


def ragas(metrics: DataFrame) -> DataFrame:
    return weighted(metrics, {"context_precision": 0.2, "context_recall": 0.2, "faithfulness": 0.3, "answer_relevancy": 0.3}, 0.25)


def composite(metrics: DataFrame, weights: dict[str, float], threshold: float = 0.7) -> DataFrame:
    return weighted(metrics, weights, 1.0).withColumn("passed", F.col("score") >= threshold)


def nli(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Per query of labels: entailment share (neutral counts half if lenient) and whether anything is contradicted."""
    of = lambda v: F.count_if(F.col("label") == v)
    top = of("entailment") if strict else of("entailment") + 0.5 * of("neutral")
    return rows.groupBy("query_id").agg((top / F.count(F.lit(1))).alias("score"), (of("contradiction") > 0).alias("hallucination"))


def hallucinations(rows: DataFrame) -> DataFrame:
    return rows.where("label = 'contradiction'").groupBy("query_id").agg(F.array_sort(F.collect_list("claim")).alias("contradictions"))


def self_rag(relevance: Column, support: Column, utility: Column) -> tuple[Column, Column]:
    """Overall score and whether to generate again."""
    overall = (relevance + support + utility) / 3
    return overall, overall < 0.5


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def token_f1(answer: Column, truth: Column) -> Column:
    """F1 of the sets of lower-cased words."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 0))
    a, b = split(answer), split(truth)
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)


def latency(rows: DataFrame, column: str) -> DataFrame:
    """Mean and linear percentiles, and rate per second."""
    p = lambda q: F.percentile(column, F.lit(q))
    return rows.agg(F.avg(column).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.try_divide(F.count(F.lit(1)), F.sum(column)).alias("per_second"))
