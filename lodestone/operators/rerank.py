"""Rerankers, reorderings and compression of ranked rows (query_id, chunk_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vec
from . import blocks
from .retrieval import in_blocks, top


def threshold(hits: DataFrame, least: float, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return hits.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def max_sim_rerank(hits: DataFrame, query_tokens: DataFrame, chunk_tokens: DataFrame, k: int = 10) -> DataFrame:
    """Late interaction: token vectors of queries (query_id, q) and chunks (chunk_id, d), arrays of vectors."""
    rows = hits.select("query_id", "chunk_id").join(query_tokens, "query_id").join(chunk_tokens, "chunk_id")
    rows = rows.select("query_id", "chunk_id", vec.max_sim(F.col("q"), F.col("d")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def soft_max_sim(hits: DataFrame, phrase_vectors: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Mean of the three best cosines between a query's phrase vectors (query_id, p) and a chunk's embedding."""
    rows = hits.select("query_id", "chunk_id").join(phrase_vectors, "query_id").join(chunks.select("chunk_id", "embedding"), "chunk_id")
    score = vec.top_mean(F.transform("p", lambda p: vec.cosine(p, F.col("embedding"))))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return rows.select("query_id", "chunk_id", score.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def max_sim_search(query_tokens: DataFrame, chunk_tokens: DataFrame, k: int = 10) -> DataFrame:
    """Late interaction of a stated set of queries (query_id, q) with all chunks (chunk_id, d), in blocks of queries."""

    def meet(part: DataFrame) -> DataFrame:
        asked = blocks.collected(part)
        return top(blocks.search(chunk_tokens, "chunk_id", "d", asked["query_id"], blocks.MaxSim(asked["q"]), k), k, "chunk_id")

    return in_blocks(query_tokens.select("query_id", "q"), "query_id", meet)


def soft_max_sim_search(phrase_vectors: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """soft_max_sim of a stated set of queries (query_id, p) with all chunks, in blocks of queries."""

    def meet(part: DataFrame) -> DataFrame:
        asked = blocks.collected(part)
        return top(blocks.search(chunks, "chunk_id", "embedding", asked["query_id"], blocks.SoftMaxSim(asked["p"]), k), k, "chunk_id")

    return in_blocks(phrase_vectors.select("query_id", "p"), "query_id", meet)


def position_scores(hits: DataFrame) -> DataFrame:
    """1 - i / n by rank."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return hits.withColumn("score", 1 - (F.col("rank") - 1) / n)


def lost_in_middle(hits: DataFrame) -> DataFrame:
    """New `position` from 0: even ranks (from 0) to the front in order, odd ones to the back in reverse."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    r = F.col("rank") - 1
    return hits.withColumn("position", F.when(r % 2 == 0, F.floor(r / 2)).otherwise(n - 1 - F.floor((r - 1) / 2)).cast("int"))


def interleave(hits: DataFrame, source: str = "source") -> DataFrame:
    """Round robin over sources in the order in which they first appear: `position` from 1."""
    turn = F.row_number().over(Window.partitionBy("query_id", source).orderBy("rank"))
    first = F.min("rank").over(Window.partitionBy("query_id", source))
    rows = hits.withColumn("__turn", turn).withColumn("__first", first)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("__turn", "__first"))).drop("__turn", "__first")


def distinct_prefix(hits: DataFrame, content: str = "content", chars: int = 200) -> DataFrame:
    """The best-ranked row of each lower-cased trimmed content prefix of a query."""
    w = Window.partitionBy("query_id", F.lower(F.trim(F.substring(content, 1, chars)))).orderBy("rank", "chunk_id")
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def greedy_budget(scored: Column, budget: Column | int, least: int = 1) -> Column:
    """Fold over structs (score order; fields tokens, ...): takes one if it fits the budget or fewer than `least` are
    taken; stops once the budget is used up and `least` are taken."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    none = F.filter(scored, lambda x: F.lit(False))
    zero = F.struct(none.alias("taken"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        take = ~acc["full"] & ((acc["used"] + x["tokens"] <= budget) | (F.size(acc["taken"]) < least))
        used = acc["used"] + F.when(take, x["tokens"]).otherwise(0)
        taken = F.when(take, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"])
        return F.struct(taken.alias("taken"), used.cast("int").alias("used"), (acc["full"] | (take & (used >= budget) & (F.size(taken) >= least))).alias("full"))

    return F.aggregate(scored, zero, step, lambda acc: acc["taken"])


def compress(hits: DataFrame, queries: DataFrame, ratio: float = 0.5, least: int = 1) -> DataFrame:
    """Extractive compression of hits (query_id, chunk_id, rank, content): per query the sentences that share most words
    with it, up to ratio of all tokens (four characters each), back in their order.

    Columns query_id, chunk_id, content, tokens. Equal scores keep the order of the chunks.
    """
    rows = hits.join(queries.select("query_id", "query"), "query_id")
    rows = rows.select("query_id", "query", "chunk_id", "rank", F.posexplode(tx.long_sentences(F.col("content"))).alias("pos", "sentence"))
    rows = rows.withColumn("tokens", tx.quarter_tokens(F.col("sentence"))).withColumn("s", tx.overlap(F.col("query"), F.col("sentence")))
    item = F.struct((-F.col("s")).alias("o"), "rank", "pos", "chunk_id", "sentence", "tokens")
    per = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("tokens").alias("total"))
    per = per.select("query_id", F.explode(greedy_budget(F.col("items"), F.floor(F.col("total") * ratio).cast("int"), least)).alias("x")).select("query_id", "x.*")
    return per.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("content"), F.sum("tokens").alias("tokens"))


def assemble_context(hits: DataFrame) -> DataFrame:
    """Per query one prompt context of hits (rank, content): numbered source blocks."""
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]\n"), F.col("content"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def scored(hits: DataFrame, queries: DataFrame, scorer, k: int = 10) -> DataFrame:
    """Rerank by a pair scorer: scorer() is built once per Arrow stream and maps lists of queries and contents to scores."""
    rows = hits.select("query_id", "chunk_id", "content", F.col("rank").alias("original_rank")).join(queries.select("query_id", "query"), "query_id")

    def run(frames):
        score = scorer()
        for frame in frames:
            yield frame[["query_id", "chunk_id", "original_rank"]].assign(score=[float(x) for x in score(frame["query"].tolist(), frame["content"].tolist())])

    kinds = dict(rows.dtypes)
    out = rows.mapInPandas(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, original_rank {kinds['original_rank']}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "original_rank", "chunk_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def compress_by_scores(sentences: DataFrame, budget: int, least: int = 1) -> DataFrame:
    """Compression by given scores: rows (query_id, chunk_id, pos, sentence, score); a null score is 5 (of 10)."""
    rows = sentences.withColumn("tokens", tx.quarter_tokens(F.col("sentence")))
    item = F.struct((-F.coalesce("score", F.lit(5.0))).alias("o"), "chunk_id", "pos", "sentence", "tokens")
    per = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = per.select("query_id", F.explode(greedy_budget(F.col("items"), budget, least)).alias("x")).select("query_id", "x.*")
    return kept.groupBy("query_id", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("content"), F.sum("tokens").alias("tokens"))
