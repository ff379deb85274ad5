"""BM25, exact vector search, rank fusion and hybrid retrieval over tables.

Queries are a table too: a batch is one plan. Only the query side is ever broadcast, and only below a row bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import blocks

#: Queries that a single plan broadcasts at most; larger batches are cut into blocks.
QUERY_BLOCK = 4096


def in_blocks(queries: DataFrame, key: str, f, most: int = QUERY_BLOCK) -> DataFrame:
    """f(queries), where f may broadcast what it is given: more rows than `most` are handled in blocks, one scan each."""
    n = queries.count()
    if n <= most:
        return f(queries)
    blocks = -(-n * 5 // (4 * most))
    out = None
    for b in range(blocks):
        part = f(queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b))
        out = part if out is None else out.unionByName(part)
    return out


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl): term frequencies and the document's length in terms, counted before any shuffle.

    Terms are counted before the shuffle too: a document's terms stand in one task, so distinct pairs are what moves.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), tx.tokens(F.col(text_col)).alias("t"))
    rows = rows.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): distinct terms of each row are counted, with one shuffle by term."""
    return docs.select(F.explode(F.array_distinct(tx.tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n documents, avgdl mean length in terms."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tx.tokens(F.col(text_col))).cast("double")).alias("avgdl"))


def bm25_score(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    idf = F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))
    return idf * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.greatest(avgdl, F.lit(1.0))))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, term, qtf): a term that a query repeats counts as often."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tx.tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def merged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """Documents as `blocks.opened` takes them (doc_id, x, t, dl), one row an id, and whether an id came twice: rows of one id are one document, as long as the first."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("x"), F.when(text.rlike(blocks.OTHER), tx.tokens(text)).alias("t"), F.lit(None).cast("int").alias("dl"))
    again = docs.select(F.xxhash64(id_col).alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__h")
    if again.isEmpty():
        return rows, False
    whole = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col).alias("__h"), tx.tokens(text).alias("t")).join(again, "__h", "left_semi").where("t is not null")
    some = whole.groupBy("doc_id").agg(F.flatten(F.collect_list("t")).alias("t"), F.first(F.size("t")).alias("dl")).withColumn("x", F.lit(None).cast("string"))
    return rows.join(again, F.xxhash64("doc_id") == F.col("__h"), "left_anti").unionByName(some), True


def ranked(rows: DataFrame, columns: list[str], queries: DataFrame, top_k: int, k1: float, b: float, stats: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of rows (doc_id and the columns that `blocks.opened` takes), by blocks of queries.

    One scan counts the documents of each asked term (and all of them, unless stats (n, avgdl) are given), a second
    scores every document where it stands and keeps the best of each task. Postings are neither listed nor shuffled.
    """

    def search(part: DataFrame) -> DataFrame:
        item = F.sort_array(F.collect_list(F.struct("term", "qtf")))
        got = blocks.collected(query_terms(part).groupBy("query_id").agg(item.alias("items")))
        asked = blocks.Asked(got["query_id"], got["items"])
        n, some, total, df = blocks.frequencies(rows, columns, asked.terms)
        avgdl = total / some if some else 0.0
        if stats is not None:
            n, avgdl = stats.select("n", F.coalesce("avgdl", F.lit(0.0))).first()
        scorer = blocks.Bm25(asked, n, avgdl, df, k1, b)
        return top(blocks.search(rows, "doc_id", columns, asked.query_ids, scorer, top_k, blocks.POSITIVE), top_k)

    return in_blocks(queries, "query_id", search)


def bm25(docs: DataFrame, queries: DataFrame, top_k: int = 10, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the best `top_k` documents of every query; ties go to the smaller doc_id."""
    rows, repeated = merged(docs, id_col, text_col)
    return ranked(rows, ["x", "t", "dl"], queries, top_k, k1, b, corpus_stats(docs, text_col) if repeated else None)


def top(scored: DataFrame, k: int, key: str = "doc_id", digits: int = 9) -> DataFrame:
    """The k best rows of each query by score, then key: ranks from 1."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", digits).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense(vectors: DataFrame, queries: DataFrame, top_k: int = 10, metric: str = "cosine", threshold: float | None = None, key: str = "vec_id", vector: str = "embedding", query_vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank) by exact search: cosine, dot, or euclidean (as 1 / (1 + distance)).

    Every vector meets every query of a stated set, as matrices in Arrow batches; blocks of queries bound what is
    broadcast, and each task hands on its best rows only.
    """
    v = vectors.select(key, F.col(vector).alias("__v"))

    def search(part: DataFrame) -> DataFrame:
        asked = blocks.collected(part)
        rows = blocks.search(v, key, "__v", asked["query_id"], blocks.Pairs(asked["__q"], metric), top_k, -math.inf if threshold is None else threshold)
        return top(rows, top_k, key)

    return in_blocks(queries.select("query_id", F.col(query_vector).alias("__q")), "query_id", search)


def centroids(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group."""
    rows = vectors.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"))


def rrf(lists: DataFrame, k: int = 60, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of ranked lists (query_id, list, chunk_id, rank): sum of w / (k + rank).

    Weights (list, weight) must name every list; without them each counts 1.
    """
    rows = lists if weights is None else lists.join(weights, "list", "left")
    weight = F.lit(1.0) if weights is None else F.coalesce("weight", F.raise_error(F.lit("a list has no weight")).cast("double"))
    return rows.groupBy("query_id", "chunk_id").agg(F.sum(weight / (F.lit(k) + F.col("rank"))).alias("score"))


def linear(lists: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Sum of weighted min-max scores of each list; a list of equal scores gives 0. Default: equal weights."""
    w = Window.partitionBy("query_id", "list")
    span = F.max("score").over(w) - F.min("score").over(w)
    rows = lists.withColumn("norm", F.when(span == 0, 0.0).otherwise((F.col("score") - F.min("score").over(w)) / span))
    if weights is None:
        n = rows.select("query_id", "list").distinct().groupBy("query_id").agg((1 / F.count(F.lit(1))).alias("weight"))
        rows = rows.join(n, "query_id")
    else:
        rows = rows.join(weights, "list")
    return rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("norm")).alias("score"))


def normalize(lists: DataFrame) -> DataFrame:
    """Min-max scores of each query; equal scores become 1."""
    w = Window.partitionBy("query_id")
    span = F.max("score").over(w) - F.min("score").over(w)
    return lists.withColumn("norm", F.when(span == 0, 1.0).otherwise((F.col("score") - F.min("score").over(w)) / span))


def keep_best(lists: DataFrame) -> DataFrame:
    """The highest score of each chunk of a query."""
    return lists.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def hybrid(dense_hits: DataFrame, sparse_hits: DataFrame, top_k: int = 10, sparse_weight: float = 0.3, k: int = 60) -> DataFrame:
    """Weighted rank fusion of two result tables (query_id, chunk_id, rank)."""
    part = lambda df, w: df.select("query_id", "chunk_id", (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("s"))
    rows = part(dense_hits, 1 - sparse_weight).unionByName(part(sparse_hits, sparse_weight))
    return top(rows.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score")), top_k, "chunk_id")


def multi_query(search, variations: DataFrame, top_k: int = 10, k: int = 60) -> DataFrame:
    """Variations (query_id, variation, query: rewrites, sub-queries or hypothetical passages) searched at once, their
    lists fused by rank. search(queries, k) is any retriever, as LexicalIndex.search."""
    asked = variations.select(F.struct("query_id", "variation").alias("query_id"), "query")
    hits = search(asked, top_k).select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.variation").alias("list"), F.col("doc_id").alias("chunk_id"), "rank")
    return top(rrf(hits, k), top_k, "chunk_id")


def adaptive(queries: DataFrame, predicate: Column, yes, no) -> DataFrame:
    """Two retrievers over the parts of a query table that a predicate makes."""
    return yes(queries.where(predicate)).unionByName(no(queries.where(~F.coalesce(predicate, F.lit(False)))))
