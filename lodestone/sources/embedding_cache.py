"""A table of vectors by key: what was embedded once isn't embedded again, and it outlives the session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.caching import embedding_key
from .vector_table import VectorTable


class EmbeddingCache:
    """Vectors (single ones, or arrays of token vectors) of one model below a path."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.model, self.table = spark, model, VectorTable(spark, path, key="key")

    def embed(self, rows: DataFrame, key: str, text: str, embedder: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
        """(key, embedding) of every row; only distinct texts that the cache lacks go to the embedder, and are kept."""
        asked = rows.select(F.col(key), F.col(text).alias("__text"), embedding_key(self.model, F.col(text)).alias("__key"))
        wanted = asked.select(F.col("__key").alias("key"), F.col("__text").alias("text")).dropDuplicates(["key"])
        if self.table.exists():
            wanted = wanted.join(self.table.scan().select("key"), "key", "left_anti")
        if not self.table.exists() or not wanted.isEmpty():
            self.table.upsert(embedder(wanted, "key", "text").select("key", "embedding"))
        return asked.join(self.table.scan().withColumnRenamed("key", "__key"), "__key").select(key, "embedding")

    def count(self) -> int:
        return self.table.count() if self.table.exists() else 0
