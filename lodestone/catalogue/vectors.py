"""Vector search and fusion."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vec
from ..operators import rerank, retrieval
from .base import TOKENS, index, q, questions, t
from .lexical import _BM25

_Q = "qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _queries(spark, sf):
    return t(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _top(metric: str, where: str = "true", k: int = 10) -> str:
    score = {"cosine": "list_cosine_similarity(qe, e)", "dot": "list_dot_product(qe, e)", "euclidean": "1 / (1 + list_distance(qe, e))"}[metric]
    return f"WITH {_Q} SELECT query_id, vec_id, round(s, 6) AS score, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rk FROM (SELECT query_id, vec_id, {score} AS s FROM qv, v WHERE {where})) WHERE rk <= {k}"


def _out(df):
    return df.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@q(_top("cosine"))
def j1_dense_cosine(spark, sf):
    return _out(retrieval.dense(t(spark, sf, "embeddings"), _queries(spark, sf)))


@q(_top("dot"))
def j1_dense_dot(spark, sf):
    return _out(retrieval.dense(t(spark, sf, "embeddings"), _queries(spark, sf), metric="dot"))


@q(_top("euclidean"))
def j1_dense_euclidean(spark, sf):
    return _out(retrieval.dense(t(spark, sf, "embeddings"), _queries(spark, sf), metric="euclidean"))


@q(_top("cosine", "label IN (1, 3) AND list_cosine_similarity(qe, e) >= 0.1", 5))
def p2_filtered_threshold(spark, sf):
    """Label filter at the scan, score threshold before ranking."""
    v = t(spark, sf, "embeddings").where(F.col("label").isin(1, 3))
    return _out(retrieval.dense(v, _queries(spark, sf), 5, threshold=0.1))


@q("SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS total, round(n, 6) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def f22_normalize(spark, sf):
    e = F.col("embedding")
    return t(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(vec.normalize(e), F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(vec.norm(e), 6).alias("norm"))


@q("SELECT label, dim, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY 1, 2")
def a38_centroids(spark, sf):
    """Mean pooling of each label's vectors."""
    return retrieval.centroids(t(spark, sf, "embeddings"), "label").select("label", F.posexplode("centroid").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


_MATRIX = "m AS (SELECT vec_id // 10 AS g, list(embedding::DOUBLE[] ORDER BY vec_id) AS d FROM embeddings GROUP BY 1)"


def _matrices(spark, sf):
    """Ten vectors after each other as the token matrix of one text; queries are those that begin with an id divisible by 50."""
    item = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])
    return t(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("g")).agg(item.alias("d"))


@q(f"""WITH {_MATRIX}, s AS (SELECT a.g AS query_id, b.g AS chunk_id, list_sum(list_transform(a.d, lambda x: list_max(list_transform(b.d, lambda y: list_dot_product(x, y))))) AS s FROM m a, m b WHERE a.g % 5 = 0)
SELECT query_id, chunk_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS r FROM s) WHERE r <= 10""")
def f23_max_sim(spark, sf):
    """Late interaction of all token matrices with the queries'."""
    m = _matrices(spark, sf)
    out = rerank.max_sim_search(m.where("g % 5 = 0").select(F.col("g").alias("query_id"), F.col("d").alias("q")), m.select(F.col("g").alias("chunk_id"), "d"))
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@q(f"""WITH {_MATRIX}, v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT g AS query_id, chunk_id, list_avg(list_reverse_sort(list_transform(d, lambda x: list_cosine_similarity(x, e)))[1:3]) AS s FROM m, v WHERE g % 5 = 0)
SELECT query_id, chunk_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS r FROM s) WHERE r <= 10""")
def f25_soft_max_sim(spark, sf):
    """Mean of the three best phrase cosines, all vectors against the queries' phrases."""
    p = _matrices(spark, sf).where("g % 5 = 0").select(F.col("g").alias("query_id"), F.col("d").alias("p"))
    out = rerank.soft_max_sim_search(p, t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"))
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


_DENSE = f"dn AS (SELECT query_id, vec_id, s, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rk FROM (SELECT query_id, vec_id, list_cosine_similarity(qe, e) AS s FROM qv, v)) WHERE rk <= 20)"
_HYB = f"{_BM25}, qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), {_DENSE}, lists AS (SELECT 'dense' AS list, query_id, vec_id AS chunk_id, s AS score, rk AS rank FROM dn UNION ALL SELECT 'sparse', query_id, doc_id, s, rk FROM bm25)"


def _lists(spark, sf):
    """Dense and sparse lists of the same queries; doc_id and vec_id are paired by number (the pairing is synthetic)."""
    ask = questions(spark, sf)
    e = t(spark, sf, "embeddings")
    qv = e.join(ask.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    dense = retrieval.dense(e, qv, 20).select(F.lit("dense").alias("list"), "query_id", F.col("vec_id").alias("chunk_id"), "score", "rank")
    sparse = index(spark, sf).search(ask).select(F.lit("sparse").alias("list"), "query_id", F.col("doc_id").alias("chunk_id"), "score", "rank")
    return dense.unionByName(sparse)


@q(f"{_HYB} SELECT query_id, chunk_id, round(sum(1 / (60 + rank)::DOUBLE), 9) AS score FROM lists GROUP BY 1, 2")
def a5_rrf(spark, sf):
    return retrieval.rrf(_lists(spark, sf)).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@q(f"{_HYB} SELECT query_id, chunk_id, round(sum(CASE list WHEN 'dense' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2")
def a6_weighted_rrf(spark, sf):
    w = spark.createDataFrame([("dense", 0.7), ("sparse", 0.3)], "list string, weight double")
    return retrieval.rrf(_lists(spark, sf), weights=w).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@q(f"""{_HYB}, n AS (SELECT *, CASE WHEN mx = mn THEN 0 ELSE (score - mn) / (mx - mn) END AS x FROM (SELECT *, max(score) OVER w AS mx, min(score) OVER w AS mn FROM lists WINDOW w AS (PARTITION BY query_id, list))),
k AS (SELECT query_id, count(DISTINCT list) AS k FROM lists GROUP BY 1)
SELECT query_id, chunk_id, round(sum(x / k), 6) AS score FROM n JOIN k USING (query_id) GROUP BY 1, 2""")
def a7_linear(spark, sf):
    return retrieval.linear(_lists(spark, sf)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@q(f"{_HYB} SELECT query_id, list, chunk_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm FROM lists WINDOW w AS (PARTITION BY query_id)")
def w6_normalize(spark, sf):
    return retrieval.normalize(_lists(spark, sf)).select("query_id", "list", "chunk_id", F.round("norm", 6).alias("norm"))


@q(f"{_HYB} SELECT query_id, chunk_id, round(max(score), 6) AS score FROM lists GROUP BY 1, 2")
def a8_keep_best(spark, sf):
    return retrieval.keep_best(_lists(spark, sf)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@q(f"""{_HYB}, f AS (SELECT query_id, chunk_id, sum(CASE list WHEN 'dense' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / (60 + rank)) AS s FROM lists GROUP BY 1, 2)
SELECT query_id, chunk_id, round(s, 9) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS r FROM f) WHERE r <= 10""")
def q3_hybrid(spark, sf):
    rows = _lists(spark, sf)
    out = retrieval.hybrid(rows.where("list = 'dense'"), rows.where("list = 'sparse'"))
    return out.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@q(f"{_HYB} SELECT query_id, chunk_id, rank, CAST(CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE n - 1 - (rank - 2) // 2 END AS BIGINT) AS position FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM lists WHERE list = 'dense')")
def w8_lost_in_middle(spark, sf):
    hits = _lists(spark, sf).where("list = 'dense'")
    return rerank.lost_in_middle(hits).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.col("position").cast("long").alias("position"))


@q(f"""{_HYB}, h AS (SELECT l.*, label AS source FROM lists l JOIN embeddings e ON e.vec_id = chunk_id WHERE list = 'dense'),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY query_id, source) AS first FROM h)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, first) AS position FROM x""")
def w9_interleave(spark, sf):
    hits = _lists(spark, sf).where("list = 'dense'").join(t(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("source")), "chunk_id")
    return rerank.interleave(hits).select("query_id", "chunk_id", F.col("position").cast("long").alias("position"))


@q(f"{_HYB} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lists WHERE list = 'dense' AND score >= 0.2 QUALIFY rank <= 5")
def p4_rerank_threshold(spark, sf):
    return rerank.threshold(_lists(spark, sf).where("list = 'dense'"), 0.2, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@q(f"{_HYB} SELECT query_id, chunk_id, round(1 - (rank - 1) / count(*) OVER (PARTITION BY query_id), 6) AS score FROM lists WHERE list = 'dense'")
def w7_position_scores(spark, sf):
    return rerank.position_scores(_lists(spark, sf).where("list = 'dense'")).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@q(f"""{_BM25} SELECT query_id, doc_id AS chunk_id FROM (SELECT query_id, b.doc_id, row_number() OVER (PARTITION BY query_id, lower(trim(text[1:200], ' ')) ORDER BY rk, b.doc_id) AS n FROM bm25 b JOIN documents USING (doc_id)) WHERE n = 1""")
def u2_distinct_prefix(spark, sf):
    docs = t(spark, sf, "documents")
    hits = index(spark, sf).search(questions(spark, sf)).join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").withColumnRenamed("doc_id", "chunk_id")
    return rerank.distinct_prefix(hits).select("query_id", "chunk_id")


@q(f"""{_BM25} SELECT query_id, md5(string_agg('[Source ' || rk || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rk)) AS m FROM bm25 JOIN documents USING (doc_id) WHERE rk <= 3 GROUP BY 1""")
def p11_context(spark, sf):
    docs = t(spark, sf, "documents")
    hits = index(spark, sf).search(questions(spark, sf), 3).join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    return rerank.assemble_context(hits).select("query_id", F.md5("context").alias("m"))


_NAMED = f"""names AS (SELECT DISTINCT w AS name FROM (SELECT unnest({TOKENS('text')}) AS w FROM benchmark) WHERE length(w) >= 8),
qn AS (SELECT DISTINCT item_id AS query_id, w AS name FROM (SELECT item_id, unnest({TOKENS('text')}) AS w FROM benchmark) JOIN names ON w = name),
dn2 AS (SELECT doc_id, w AS name, count(*) AS mentions FROM (SELECT doc_id, unnest({TOKENS('text')}) AS w FROM documents) JOIN names ON w = name GROUP BY 1, 2),
gr AS (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sum(mentions) DESC, doc_id) AS rank FROM qn JOIN dn2 USING (name) GROUP BY 1, 2),
three AS (SELECT list, query_id, chunk_id, rank FROM lists UNION ALL SELECT 'graph', query_id, chunk_id, rank FROM gr WHERE rank <= 10)"""


@q(f"{_HYB}, {_NAMED} SELECT query_id, chunk_id, round(sum(CASE list WHEN 'dense' THEN 0.5::DOUBLE WHEN 'sparse' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END / (60 + rank)), 9) AS score FROM three GROUP BY 1, 2")
def q14_graph_hybrid(spark, sf):
    """Q14: dense, sparse and graph lists (documents that mention the query's entities) fused by weighted rank."""
    from ..operators import graph

    ask = questions(spark, sf)
    name = ask.select(F.explode(tx.tokens(F.col("query"))).alias("name")).where(F.length("name") >= 8).distinct().withColumn("type", F.lit("Concept"))
    held = graph.dictionary_entities(t(spark, sf, "documents"), name)
    asked = graph.dictionary_entities(ask, name, "query_id", "query").withColumnRenamed("doc_id", "query_id")
    listed = graph.mention_list(asked, held, 10).withColumnRenamed("doc_id", "chunk_id").select(F.lit("graph").alias("list"), "query_id", "chunk_id", "score", "rank")
    w = spark.createDataFrame([("dense", 0.5), ("sparse", 0.3), ("graph", 0.2)], "list string, weight double")
    return retrieval.rrf(_lists(spark, sf).unionByName(listed), weights=w).select("query_id", "chunk_id", F.round("score", 9).alias("score"))
