"""Retrieval over a tree of summaries: nodes (doc_id, node_id, level, parent_id, is_summary, content), level 0 the leaves.

hits are scored nodes (query_id, node_id, score) from any retriever; filters on levels apply before the cut to k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import top


def collapsed(hits: DataFrame, nodes: DataFrame, k: int = 10, prefix: int = 100) -> DataFrame:
    """All levels at once: twice k nodes, the best of each content prefix, then by level and score, k of them."""
    rows = top(hits, 2 * k, "node_id").join(nodes.select("node_id", "level", "content"), "node_id")
    w = Window.partitionBy("query_id", F.substring("content", 1, prefix)).orderBy("rank", "node_id")
    rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    order = Window.partitionBy("query_id").orderBy("level", F.round("score", 9).desc(), "node_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "node_id", "level", "score", "rank")


def traversal(hits: DataFrame, nodes: DataFrame, k: int = 9) -> DataFrame:
    """A third of the places for the best summaries, the rest for the best leaves below them or, where those are too few, elsewhere."""
    rows = hits.join(nodes.select("node_id", "is_summary", "parent_id"), "node_id")
    summaries = top(rows.where("is_summary"), max(1, k // 3), "node_id")
    chosen = summaries.select("query_id", F.col("node_id").alias("parent_id"), F.lit(1).alias("below"))
    leaves = rows.where("not is_summary").join(chosen, ["query_id", "parent_id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.coalesce("below", F.lit(0)).desc(), F.round("score", 9).desc(), "node_id")
    leaves = leaves.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k - max(1, k // 3))
    pick = lambda df, kind: df.select("query_id", "node_id", "score", F.lit(kind).alias("kind"), "rank")
    return pick(summaries, "summary").unionByName(pick(leaves, "leaf"))


def at_level(hits: DataFrame, nodes: DataFrame, level: int, k: int = 10) -> DataFrame:
    return top(hits.join(nodes.where(F.col("level") == level).select("node_id"), "node_id", "left_semi"), k, "node_id")


def with_parents(hits: DataFrame, nodes: DataFrame, chars: int = 200) -> DataFrame:
    """Leaves with the beginning of their parent's summary in front; lone leaves stay as they are."""
    leaf = hits.join(nodes.where("level = 0").select("node_id", "parent_id", "content"), "node_id")
    up = nodes.select(F.col("node_id").alias("parent_id"), F.substring("content", 1, chars).alias("summary"))
    return leaf.join(up, "parent_id", "left").withColumn("content", F.when(F.col("summary").isNotNull(), F.concat(F.lit("[Summary: "), "summary", F.lit("]\n\n"), "content")).otherwise(F.col("content")))
