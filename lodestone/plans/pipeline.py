"""The retrieval pipeline as one lazy plan over a table of queries, and the driver loops around it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import parse, rules
from ..functions import text as tx
from ..operators import chunking, rerank, retrieval
from ..session import Workspace
from . import providers


class PipelineBuilder:
    """Fluent configuration; build() gives a pipeline over a chunk table."""

    def __init__(self) -> None:
        self.config = EngineConfig()
        self.chunker = chunking.sentence_chunks
        self.embedder: providers.Embedder = providers.HashEmbedder()
        self.generator: providers.Generator = providers.ExtractiveGenerator()
        self.options = {"rerank": True, "compress": False, "multi_query": False}

    def with_config(self, **changes) -> PipelineBuilder:
        self.config = replace(self.config, **changes)
        return self

    def with_chunker(self, chunker) -> PipelineBuilder:
        self.chunker = chunker
        return self

    def with_embedder(self, embedder) -> PipelineBuilder:
        self.embedder = embedder
        return self

    def with_generator(self, generator) -> PipelineBuilder:
        self.generator = generator
        return self

    def with_options(self, **options) -> PipelineBuilder:
        unknown = set(options) - set(self.options)
        if unknown:
            raise ValueError(f"unknown options {sorted(unknown)}")
        self.options |= options
        return self

    def build(self) -> Pipeline:
        return Pipeline(self)


class Pipeline:
    def __init__(self, b: PipelineBuilder):
        self.config, self.chunker, self.embedder, self.generator, self.options = b.config, b.chunker, b.embedder, b.generator, dict(b.options)

    def ingest(self, docs: DataFrame) -> DataFrame:
        """(chunk_id, doc_id, position, content, embedding), written: every part of a search reads it again."""
        chunks = self.chunker(docs)
        if hasattr(self.embedder, "embed_in_place"):
            made = self.embedder.embed_in_place(chunks, "content")
        else:
            made = chunks.join(self.embedder.embed(chunks, "chunk_id", "content"), "chunk_id")
        return Workspace(docs.sparkSession, "chunks").table("chunks", made)

    def retrieve(self, chunks: DataFrame, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, chunk_id, rank, score, content): dense and BM25 lists fused by rank, then reranked by shared words."""
        c = self.config
        k = top_k or c.top_k
        most = min(c.hybrid_factor * c.rerank_factor * k, c.hybrid_most)
        vectors = self.embedder.embed(queries, "query_id", "query")
        dense = retrieval.dense(chunks, vectors, most, key="chunk_id")
        sparse = retrieval.bm25(chunks, queries, most, "chunk_id", "content").withColumnRenamed("doc_id", "chunk_id")
        work = Workspace(chunks.sparkSession, "hits")
        fused = work.table("fused", retrieval.hybrid(dense, sparse, c.rerank_factor * k if self.options["rerank"] else k, c.sparse_weight, c.rrf_k))
        few = queries.count() <= retrieval.QUERY_BLOCK
        hits = (F.broadcast(fused) if few else fused).join(chunks.select("chunk_id", "content"), "chunk_id")
        if self.options["rerank"]:
            scored = hits.join(queries.select("query_id", "query"), "query_id").withColumn("score", tx.overlap(F.col("query"), F.col("content")) + F.col("score"))
            hits = retrieval.top(scored.drop("query", "rank"), k, "chunk_id")
        return work.table("hits", hits.select("query_id", "chunk_id", "rank", "score", "content"))

    def assess(self, hits: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, ratio, mean, quality, action) by keyword overlap of the first ten chunks."""
        rows = hits.where("rank <= 10").join(queries.select("query_id", "query"), "query_id").withColumn("o", tx.overlap(F.col("query"), F.col("content")))
        per = rows.groupBy("query_id").agg(F.avg(rules.relevant(F.col("o")).cast("double")).alias("ratio"), F.avg(rules.overlap_score(F.col("o"))).alias("mean"))
        per = per.withColumn("quality", rules.retrieval_quality(F.col("ratio"), F.col("mean")))
        return per.withColumn("action", rules.correction(F.col("quality")))

    def query(self, chunks: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, response, sources, citations, confidence)."""
        hits = self.retrieve(chunks, queries)
        if self.options["compress"]:
            hits = rerank.compress(hits, queries)
        context = rerank.assemble_context(hits).join(queries.select("query_id", "query"), "query_id")
        answers = self.generator.generate(context)
        n = hits.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("sources"))
        out = answers.join(n, "query_id")
        return out.withColumn("citations", parse.citations(F.col("response"), F.col("sources"))).withColumn("confidence", rules.confidence(F.col("sources")))

    def corrective(self, chunks: DataFrame, queries: DataFrame, rewrite=None) -> DataFrame:
        """A driver state machine over whole query tables: retrieve, assess, and retrieve again for the queries whose
        hits are poor (rewritten) or partial (twice as many), at most max_iterations times; then answer all of them."""
        waiting, done = queries.select("query_id", "query"), None
        k = self.config.top_k
        for i in range(self.config.max_iterations):
            hits = self.retrieve(chunks, waiting, k)
            judged = self.assess(hits, waiting)
            last = i == self.config.max_iterations - 1
            good = waiting if last else waiting.join(judged.where("action = 'proceed'"), "query_id", "left_semi")
            part = hits.join(good.select("query_id"), "query_id", "left_semi")
            done = part if done is None else done.unionByName(part)
            if last:
                break
            waiting = waiting.join(good.select("query_id"), "query_id", "left_anti")
            if waiting.isEmpty():
                break
            if rewrite is not None:
                waiting = rewrite(waiting)
            k *= 2
        context = rerank.assemble_context(done).join(queries.select("query_id", "query"), "query_id")
        return self.generator.generate(context)


def hypothetical(pipeline: Pipeline, chunks: DataFrame, queries: DataFrame, passages: DataFrame, top_k: int = 10) -> DataFrame:
    """Hypothetical passages (query_id, n, passage) searched in place of the query, their lists fused by rank."""
    asked = passages.select(F.concat_ws("#", "query_id", "n").alias("query_id"), F.col("passage").alias("query"))
    hits = pipeline.retrieve(chunks, asked, top_k)
    lists = hits.select(F.split("query_id", "#")[0].alias("query_id"), F.split("query_id", "#")[1].alias("list"), "chunk_id", "rank")
    return retrieval.top(retrieval.rrf(lists), top_k, "chunk_id")


def expanded(pipeline: Pipeline, chunks: DataFrame, queries: DataFrame, rewrites: DataFrame, top_k: int = 10) -> DataFrame:
    """Queries and their rewrites (query_id, n, query: variations, sub-queries or a step back), searched at once, fused by rank."""
    every = queries.select("query_id", F.lit(0).alias("n"), "query").unionByName(rewrites.select("query_id", F.col("n").cast("int").alias("n"), "query"))
    asked = every.select(F.concat_ws("#", "query_id", "n").alias("query_id"), "query")
    hits = pipeline.retrieve(chunks, asked, top_k)
    lists = hits.select(F.split("query_id", "#")[0].alias("query_id"), F.split("query_id", "#")[1].alias("list"), "chunk_id", "rank")
    return retrieval.top(retrieval.rrf(lists), top_k, "chunk_id")
