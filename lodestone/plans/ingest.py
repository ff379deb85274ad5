"""Batch ingestion: documents in, chunks with vectors in a collection, one row of status for every document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, cluster
from ..session import Workspace
from ..sources import files
from ..sources.vector_table import VectorTable


class BatchIngester:
    """Load, chunk, embed and upsert as tables. A document that can't be read or has no text fails alone."""

    def __init__(self, table: VectorTable, chunker: Callable[..., DataFrame] = chunking.sentence_chunks, embed: Callable[[DataFrame, str, str], DataFrame] = cluster.hash_embed):
        self.table, self.chunker, self.embed = table, chunker, embed

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Status rows (source, status, chunks, error) of docs (source, filename, text, error); status is ingested, known or failed.

        A document is known by its name and content: what was ingested before is left alone.
        """
        work = Workspace(docs.sparkSession, "ingest")
        docs = docs.withColumn("error", F.when(F.col("error").isNull() & (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0), "no text").otherwise(F.col("error")))
        known = self.table.scan().select("source_file").distinct() if self.table.exists() else docs.sparkSession.createDataFrame([], "source_file string")
        good = docs.where("error is null")
        new = work.table("new", files.new_only(good, known))
        chunks = work.table("chunks", self.chunker(new.select(F.col("source").alias("doc_id"), "text")).join(new.select(F.col("source").alias("doc_id"), "source_file"), "doc_id"))
        ready = chunks.join(self.embed(chunks, "chunk_id", "content"), "chunk_id")
        if not chunks.isEmpty():
            self.table.upsert(ready.select("chunk_id", "doc_id", "position", "content", "source_file", "embedding"))
        counts = chunks.groupBy(F.col("doc_id").alias("source")).agg(F.count(F.lit(1)).alias("chunks"))
        status = docs.select("source", "error").join(new.select("source", F.lit(True).alias("__new")), "source", "left").join(counts, "source", "left")
        kind = F.when(F.col("error").isNotNull(), "failed").when(F.col("__new"), "ingested").otherwise("known")
        return status.select("source", kind.alias("status"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), "error")

    def ingest_folder(self, spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
        return self.ingest(files.load(spark, path, recursive))

    @staticmethod
    def summary(status: DataFrame) -> DataFrame:
        """One row: documents, ingested, known, failed, chunks."""
        of = lambda s: F.count_if(F.col("status") == s).alias(s)
        return status.agg(F.count(F.lit(1)).alias("documents"), of("ingested"), of("known"), of("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
