"""Caches as tables: semantic probe, exact keys, expiry and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace
from . import blocks
from .retrieval import in_blocks


def alive(cache: DataFrame, now: Column, ttl: Column, created: str = "created_at") -> DataFrame:
    return cache.where(now - F.col(created) <= ttl)


def probe(cache: DataFrame, queries: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The most similar cache entry of each query at or above the threshold: (query_id, entry_id, similarity).

    Entries meet all rows of a stated query set; ties go to the smaller entry.
    """

    def meet(part: DataFrame) -> DataFrame:
        asked = blocks.collected(part)
        return blocks.search(cache, "entry_id", "embedding", asked["query_id"], blocks.Pairs(asked["__q"], "cosine"), 1, threshold)

    rows = in_blocks(queries.select("query_id", F.col("embedding").alias("__q")), "query_id", meet)
    return rows.groupBy("query_id").agg(F.min_by("entry_id", F.struct(-F.round("score", 9), F.col("entry_id"))).alias("entry_id"), F.max("score").alias("similarity"))


def embedding_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}:"), text), 256)


def split(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits and misses of rows with a key column."""
    return texts.join(cache, "key"), texts.join(cache.select("key"), "key", "left_anti")


def evict_oldest(cache: DataFrame, share: float = 0.1) -> DataFrame:
    """Without the oldest share of entries (rounded down, one at least); ties by entry.

    Entries are dealt into ranges by age and written; the counts of the ranges (one row each) say which go as a whole,
    and only the range that the cut falls into is ranked.
    """
    spark = cache.sparkSession
    work = Workspace(spark, "evict")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cache.select("entry_id", "created_at").repartitionByRange(parts, "created_at", "entry_id")
    dealt = work.table("ranges", dealt.withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    left, whole, edge = max(1, int(sum(n for _, n in sizes) * share)), [], -1
    for part, n in sizes:
        if n > left:
            edge = part
            break
        whole.append(part)
        left -= n
    w = Window.orderBy("created_at", "entry_id")
    ranked = dealt.where(F.col("part") == edge).withColumn("r", F.row_number().over(w)).where(F.col("r") <= left)
    gone = dealt.where(F.col("part").isin(whole)).select("entry_id").unionByName(ranked.select("entry_id"))
    return cache.join(gone, "entry_id", "left_anti")


def keep_last(rows: DataFrame, by: str, order: str, n: int, tie: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col(order).desc(), F.col(tie).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def stats(cache: DataFrame, lookups: DataFrame) -> DataFrame:
    """Entries, hits, lookups and hit rate (lookups has boolean hit)."""
    return cache.agg(F.count(F.lit(1)).alias("entries")).crossJoin(lookups.agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("lookups"))).withColumn("hit_rate", F.try_divide("hits", "lookups"))
