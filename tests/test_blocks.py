"""Exact search in Arrow batches against all pairs by column expressions, odd rows included."""

import random

from lodestone.functions import vector as vec
from lodestone.operators import caching, rerank, retrieval
from pyspark.sql import functions as F

_R = random.Random(7)
VECTORS = [[_R.uniform(-1, 1) for _ in range(6)] for _ in range(40)]
ODD = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], VECTORS[3], VECTORS[3]]


def no_pairs(df):
    """No pair of a row and a query is a row of the plan."""
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def same(got, scored, key, k=3):
    rows = lambda df: sorted((r.query_id, r["rank"], r[key], r.score if r.score is None else round(r.score, 8)) for r in df.select("query_id", "rank", key, "score").collect())
    assert rows(got) == rows(retrieval.top(scored, k, key))


def matrices(spark, key, name):
    rows = [(i, VECTORS[i : i + 1 + i % 4]) for i in range(12)] + [(20, None), (21, []), (22, [None]), (23, [VECTORS[1], None]), (24, [[1.0, 2.0]]), (25, VECTORS[3:7]), (26, VECTORS[3:7]), (27, [VECTORS[0], [1.0, None, 0.0, 0.0, 0.0, 0.0]])]
    return spark.createDataFrame(rows, f"{key} long, {name} array<array<double>>").repartition(3)


def test_max_sim_search_makes_no_pairs(spark):
    """F2."""
    q, d = matrices(spark, "query_id", "q"), matrices(spark, "chunk_id", "d")
    got = rerank.max_sim_search(q, d, 3)
    no_pairs(got)
    same(got, q.crossJoin(d).select("query_id", "chunk_id", vec.max_sim(F.col("q"), F.col("d")).alias("score")), "chunk_id")


def vectors(spark, key, name="embedding"):
    return spark.createDataFrame(list(enumerate(VECTORS + ODD)), f"{key} long, {name} array<double>").repartition(3)


def test_soft_max_sim_search_makes_no_pairs(spark):
    """F3."""
    q, d = matrices(spark, "query_id", "p"), vectors(spark, "chunk_id")
    got = rerank.soft_max_sim_search(q, d, 5)
    no_pairs(got)
    score = vec.top_mean(F.transform("p", lambda p: vec.cosine(p, F.col("embedding"))))
    same(got, q.crossJoin(d).select("query_id", "chunk_id", score.alias("score")), "chunk_id", 5)


def test_cache_probe_makes_no_pairs(spark):
    """F5."""
    e, q = vectors(spark, "entry_id"), vectors(spark, "query_id")
    got = caching.probe(e, q, 0.2)
    no_pairs(got)
    pairs = q.select("query_id", F.col("embedding").alias("q")).crossJoin(e).select("query_id", "entry_id", vec.cosine(F.col("q"), F.col("embedding")).alias("score")).where("score >= 0.2")
    assert sorted((r.query_id, r.entry_id) for r in got.collect()) == sorted((r.query_id, r.entry_id) for r in retrieval.top(pairs, 1, "entry_id").collect())


def test_dense_makes_no_pairs(spark):
    """F4."""
    e, q = vectors(spark, "vec_id"), vectors(spark, "query_id", "embedding")
    for metric, score in (("cosine", vec.cosine(F.col("q"), F.col("embedding"))), ("dot", vec.dot(F.col("q"), F.col("embedding"))), ("euclidean", 1 / (1 + vec.euclidean(F.col("q"), F.col("embedding"))))):
        got = retrieval.dense(e, q, 4, metric)
        no_pairs(got)
        same(got, q.select("query_id", F.col("embedding").alias("q")).crossJoin(e).select("query_id", "vec_id", score.alias("score")), "vec_id", 4)


def test_tokens_are_those_of_the_jvm(spark):
    """every character that is cut in Arrow batches, alone and between letters, and texts that are not."""
    import pyarrow as pa
    from lodestone.functions import text as tx
    from lodestone.operators import blocks

    chars = [chr(i) for i in range(0x180) if i != 0x130]
    texts = [*chars, *(f"a{c}B{c}" for c in chars), "", " ", "Ñandú_9 ÷x× ²µ", *(f"{c}{c}" for c in chars)]
    want = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", tx.tokens(F.col("x")).alias("t")).orderBy("i").collect()]
    assert blocks.cut(pa.array(texts)).to_pylist() == want
    assert blocks.cut(pa.array(["skip", *texts]).slice(1)).to_pylist() == want
    assert [r[0] for r in spark.createDataFrame([("ſ",), ("İ",), ("日",), ("ƀ",)], "x string").select(F.col("x").rlike(blocks.OTHER)).collect()] == [False, True, True, True]


def test_bm25_lists_no_postings(spark):
    """odd texts, repeated and null ids, in both forms, against postings joined with queries."""
    from lodestone.operators.lexical_index import LexicalIndex

    r = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["ñu", "日本", "ΣΑΣ", "İx"]
    docs = [(i, " ".join(r.choices(words, weights=[1 / (1 + j) for j in range(len(words))], k=r.randrange(40)))) for i in range(60)]
    docs += [(60, None), (61, ""), (5, docs[5][1]), (None, "w1 w2 日本"), (None, "w1 w2 日本"), (62, "ñu ñu ΣΑΣ İx")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    ask = spark.createDataFrame([(i, " ".join(r.choices(words, k=6))) for i in range(12)] + [(20, ""), (21, None), (22, "unknown"), (23, "日本 ΣΑΣ İx")], "query_id long, query string")
    asked = retrieval.query_terms(ask)
    hits = retrieval.postings(docs)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(df, "term").join(asked, "term").crossJoin(retrieval.corpus_stats(docs))
    score = F.sum(F.col("qtf") * retrieval.bm25_score(F.col("n"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl")))
    pairs = rows.groupBy("query_id", "doc_id").agg(score.alias("score"))
    for got in (retrieval.bm25(docs, ask, 5), LexicalIndex(spark).build(docs).search(ask, 5)):
        plan = got._jdf.queryExecution().toString()
        assert "Generate" not in plan
        same(got, pairs, "doc_id", 5)
