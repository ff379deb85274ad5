"""Tokens, BM25, overlap."""

from pyspark.sql import functions as F

from ..functions import parse, rules
from ..functions import text as tx
from ..operators import retrieval
from .base import SENTENCES, SPLIT_LOW, TOKENS, WORDS, index, q, questions, t

def ranked_sql(corpus: str, queries: str, k: int = 10, name: str = "") -> str:
    """CTEs that end in r{name} (query_id, list, id, s, rk): BM25 of a corpus (id, text) for queries (query_id, list, query)."""
    n = name
    return f"""corp{n} AS ({corpus}), tok{n} AS (SELECT id, {TOKENS('text')} AS ts FROM corp{n}),
post{n} AS (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tok{n}),
tf{n} AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM post{n} GROUP BY 1, 2),
df{n} AS (SELECT term, count(*) AS df FROM tf{n} GROUP BY 1),
st{n} AS (SELECT count(*) AS n, avg(CAST(len(ts) AS DOUBLE)) AS avgdl FROM tok{n}),
qt{n} AS (SELECT query_id, list, term, count(*) AS qtf FROM (SELECT query_id, list, unnest({TOKENS('query')}) AS term FROM ({queries})) GROUP BY 1, 2, 3),
sc{n} AS (
  SELECT query_id, list, id, sum(qtf * (ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avgdl, 1))))) AS s
  FROM tf{n} JOIN df{n} USING (term) JOIN qt{n} USING (term), st{n} GROUP BY 1, 2, 3),
r{n} AS (SELECT query_id, list, id, s, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY round(s, 9) DESC, id) AS rk FROM sc{n}) WHERE rk <= {k})"""


_POST = f"""tok AS (SELECT doc_id, {TOKENS('text')} AS ts FROM documents),
post AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM post GROUP BY 1, 2)"""
_DOCS, _ASK = "SELECT doc_id AS id, text FROM documents", "SELECT item_id AS query_id, 0 AS list, text AS query FROM benchmark"
_BM25 = f"WITH {ranked_sql(_DOCS, _ASK)}, bm25 AS (SELECT query_id, id AS doc_id, s, rk FROM r)"


@q(f"{_BM25} SELECT query_id, doc_id, round(s, 6) AS score, rk AS rank FROM bm25")
def s_bm25_topk(spark, sf):
    """BM25 end to end, ten documents for each benchmark item."""
    return index(spark, sf).search(questions(spark, sf)).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@q(f"{_BM25} SELECT query_id, doc_id, round(s, 6) AS score, rk AS rank FROM bm25")
def j2_bm25_unindexed(spark, sf):
    """The same without a stored index, over whatever table comes."""
    return retrieval.bm25(t(spark, sf, "documents"), questions(spark, sf)).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@q(f"SELECT doc_id, CAST(len({TOKENS('text')}) AS BIGINT) AS n_tokens, array_to_string({TOKENS('text')}[1:5], ' ') AS head FROM documents")
def f1_tokens(spark, sf):
    x = tx.tokens(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.size(x).cast("long").alias("n_tokens"), F.array_join(F.slice(x, 1, 5), " ").alias("head"))


@q(f"WITH {_POST} SELECT doc_id, term, tf, CAST(dl AS BIGINT) AS dl FROM tf")
def a1_term_frequency(spark, sf):
    return retrieval.postings(t(spark, sf, "documents")).select("doc_id", "term", "tf", F.col("dl").cast("long").alias("dl"))


@q(f"WITH {_POST} SELECT term, count(*) AS df FROM tf GROUP BY term")
def a2_document_frequency(spark, sf):
    return retrieval.document_frequency(t(spark, sf, "documents"))


@q(f"SELECT count(*) AS n, round(avg(CAST(len({TOKENS('text')}) AS DOUBLE)), 6) AS avgdl FROM documents")
def a3_corpus_stats(spark, sf):
    return retrieval.corpus_stats(t(spark, sf, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


@q(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest FROM (SELECT doc_id, {SENTENCES('text')} AS s FROM documents)")
def f2_sentences(spark, sf):
    s = tx.sentences(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).cast("long").alias("longest"))


@q(f"SELECT doc_id, CAST(len(list_filter({SENTENCES('text')}, lambda x: length(x) > 20)) AS BIGINT) AS n FROM documents")
def f4_long_sentences(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(tx.long_sentences(F.col("text"))).cast("long").alias("n"))


@q(f"SELECT doc_id, CAST(floor(len({WORDS('text')}) * 1.3::DOUBLE) AS BIGINT) AS by_words, CAST(length(text) // 4 AS BIGINT) AS by_chars FROM documents")
def f20_token_estimates(spark, sf):
    return t(spark, sf, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).cast("long").alias("by_words"), tx.quarter_tokens(F.col("text")).cast("long").alias("by_chars"))


_OVER = f"""{_BM25}, pairs AS (
  SELECT query_id, doc_id, list_distinct({SPLIT_LOW('b.text')}) AS a, {SPLIT_LOW('d.text')} AS w FROM bm25 JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id))"""


@q(f"{_OVER} SELECT query_id, doc_id, round(len(list_intersect(a, w)) / len(a), 6) AS overlap, round(len(list_intersect(a, w)) / len(list_distinct(list_concat(a, w))), 6) AS jaccard FROM pairs")
def f19_keyword_overlap(spark, sf):
    """Word overlap and Jaccard of queries with their hits."""
    hits = index(spark, sf).search(questions(spark, sf)).join(t(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(questions(spark, sf), "query_id")
    return hits.select("query_id", "doc_id", F.round(tx.overlap(F.col("query"), F.col("text")), 6).alias("overlap"), F.round(tx.jaccard(F.col("query"), F.col("text")), 6).alias("jaccard"))


@q(f"""SELECT item_id AS query_id, array_to_string(list_concat(
  CASE WHEN list_contains(p, text) THEN p ELSE list_concat([text], p) END, list_filter({WORDS('text')}, lambda w: length(w) > 4)[1:5])[1:10], '|') AS phrases
FROM (SELECT item_id, text, list_filter(list_transform(regexp_split_to_array(lower(text), '[,;:]|\\band\\b|\\bor\\b'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM benchmark)""")
def f24_phrases(spark, sf):
    return questions(spark, sf).select("query_id", F.array_join(tx.phrases(F.col("query")), "|").alias("phrases"))


@q("SELECT doc_id, sha256(text) AS sha, sha256(text)[1:16] AS short, md5(text) AS md5 FROM documents")
def f39_hash_keys(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha2("text", 256), 1, 16).alias("short"), F.md5("text").alias("md5"))


@q("SELECT doc_id, length(CASE WHEN length(text) > 800 THEN text[1:400] || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 400) ELSE text END) AS n, md5(CASE WHEN length(text) > 800 THEN text[1:400] || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 400) ELSE text END) AS m FROM documents")
def f42_truncate(spark, sf):
    x = tx.truncate_middle(F.col("text"), 400, 400)
    return t(spark, sf, "documents").select("doc_id", F.length(x).cast("long").alias("n"), F.md5(x).alias("m"))


_HALF = "length(text) // 2"
_VARIED = f"""SELECT item_id AS query_id, 0 AS list, text AS query FROM benchmark UNION ALL SELECT item_id, 1, text[1 : {_HALF}] FROM benchmark UNION ALL SELECT item_id, 2, text[{_HALF} + 1 :] FROM benchmark"""
_FUSED = "f AS (SELECT query_id, id AS chunk_id, sum(1 / (60 + rk)::DOUBLE) AS s FROM r GROUP BY 1, 2), best AS (SELECT query_id, chunk_id, s, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rk FROM f) WHERE rk <= 10)"


def _variations(spark, sf):
    """Each benchmark item with its two halves."""
    ask = questions(spark, sf)
    half = F.floor(F.length("query") / 2).cast("int")
    part = lambda n, c: ask.select("query_id", F.lit(n).alias("variation"), c.alias("query"))
    return part(0, F.col("query")).unionByName(part(1, F.substring(F.col("query"), F.lit(1), half))).unionByName(part(2, F.substring(F.col("query"), half + 1, F.length("query"))))


def _ranked(df):
    return df.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@q(f"WITH {ranked_sql(_DOCS, _VARIED)}, {_FUSED} SELECT query_id, chunk_id, round(s, 9) AS score, rk AS rank FROM best")
def q4_multi_query(spark, sf):
    """Q4, A5: every query with two variations, searched at once, their lists fused by rank."""
    return _ranked(retrieval.multi_query(index(spark, sf).search, _variations(spark, sf)))


_PARTS = f"SELECT item_id AS query_id, 0 AS list, 'part one ' || text[1 : {_HALF}] AS query FROM benchmark UNION ALL SELECT item_id, 1, 'part two ' || text[{_HALF} + 1 :] FROM benchmark"


@q(f"WITH {ranked_sql(_DOCS, _PARTS)}, {_FUSED} SELECT query_id, chunk_id, round(s, 9) AS score, rk AS rank FROM best")
def q5_decomposition(spark, sf):
    """Sub-queries read from a recorded answer, searched at once, their lists fused by rank."""
    ask = questions(spark, sf)
    one = F.regexp_replace("query", r"[\r\n]", " ")
    half = F.floor(F.length("query") / 2).cast("int")
    answer = F.concat(F.lit("1. part one "), F.substring(one, F.lit(1), half), F.lit("\n\n2) part two "), F.substring(one, half + 1, F.length("query")))
    parts = ask.select("query_id", F.posexplode(parse.sub_queries(answer)).alias("variation", "query"))
    return _ranked(retrieval.multi_query(index(spark, sf).search, parts))


_BLANK = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '\\n\\n+', chr(10) || chr(1), 'g'), '([.!?])\\s+(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '')".format


@q(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS m FROM (SELECT doc_id, {_BLANK('text')} AS s FROM documents)")
def f3_sentences(spark, sf):
    """sentences that begin with a capital, or stretches between blank lines."""
    s = tx.sentences_or_blank(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("m"))


_PASSAGES = f"SELECT item_id AS query_id, 0 AS list, 'A passage that answers: ' || text AS query FROM benchmark UNION ALL SELECT item_id, 1, text[{_HALF} + 1 :] FROM benchmark"


def _passages(ask):
    """Recorded hypothetical passages, two a query."""
    half = F.floor(F.length("query") / 2).cast("int")
    first = ask.select("query_id", F.lit(0).alias("variation"), F.concat(F.lit("A passage that answers: "), "query").alias("query"))
    return first.unionByName(ask.select("query_id", F.lit(1).alias("variation"), F.substring(F.col("query"), half + 1, F.length("query")).alias("query")))


@q(f"WITH {ranked_sql(_DOCS, _PASSAGES)}, {_FUSED} SELECT query_id, chunk_id, round(s, 9) AS score, rk AS rank FROM best")
def q7_hypothetical(spark, sf):
    """Q7: hypothetical passages searched in place of their query, fused by rank."""
    return _ranked(retrieval.multi_query(index(spark, sf).search, _passages(questions(spark, sf))))


@q(f"""WITH {ranked_sql(_DOCS, _PASSAGES)}, {_FUSED}, {ranked_sql(_DOCS, _ASK, name="p")},
w AS (SELECT item_id AS query_id, item_id % 2 = 0 AND len({WORDS('text')}) > 3 AND (starts_with(lower(text), 'explain') OR len({WORDS('text')}) > 5) AS hyde FROM benchmark)
SELECT query_id, chunk_id, round(s, 9) AS score, rk AS rank FROM best JOIN w USING (query_id) WHERE hyde UNION ALL SELECT query_id, id, round(s, 9), rk FROM rp JOIN w USING (query_id) WHERE NOT hyde""")
def q8_adaptive(spark, sf):
    """Hypothetical passages for the queries that gain from them (here: even items), plain search for the rest."""
    search = index(spark, sf).search
    plain = lambda part: search(part).select("query_id", F.col("doc_id").alias("chunk_id"), "score", "rank")
    gains = rules.use_hypothetical(F.col("query")) & (F.col("query_id") % 2 == 0)
    return _ranked(retrieval.adaptive(questions(spark, sf), gains, lambda part: retrieval.multi_query(search, _passages(part)).select("query_id", "chunk_id", "score", "rank"), plain))


_TRUTH = "truth AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@q(f"""{_BM25}, {_TRUTH},
good AS (SELECT b.query_id, min(rk) AS first, count(*) AS found, sum(1 / log2(rk + 1)) AS dcg FROM bm25 b JOIN truth USING (query_id, doc_id) GROUP BY 1),
ideal AS (SELECT query_id, count(*) AS n, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM truth GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(found, 0) / n), 6) AS recall, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg
FROM ideal LEFT JOIN good USING (query_id)""")
def a29_rank_metrics(spark, sf):
    """Hit rate, MRR, recall and NDCG; truth: documents that hold the item word for word."""
    from ..operators import evaluate

    docs, ask = t(spark, sf, "documents"), questions(spark, sf)
    found = index(spark, sf)
    out = evaluate.rank_metrics(found.search(ask), found.containing(docs, ask))
    return out.select("queries", *(F.round(c, 6).alias(c) for c in ("hit_rate", "mrr", "recall", "ndcg")))
