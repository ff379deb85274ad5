"""Evaluation, parsing, rules and caches."""

from pyspark.sql import functions as F

from ..functions import parse, rules
from ..functions import text as tx
from ..functions import vector as vec
from ..operators import caching, evaluate, metrics, retrieval
from ..plans import providers
from ..session import Workspace
from .base import SPLIT_LOW, WORDS, index, q, questions, t
from .lexical import _ASK, _BM25, ranked_sql

_V = "CASE toxic + quality WHEN 0 THEN 'contradicted' WHEN 1 THEN 'supported' ELSE 'neutral' END"


def _claims(spark, sf):
    verdict = F.when(F.col("toxic") + F.col("quality") == 0, "contradicted").when(F.col("toxic") + F.col("quality") == 1, "supported").otherwise("neutral")
    rows = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return rows.select(F.col("source").alias("query_id"), F.concat(F.lit("claim "), F.col("doc_id").cast("string")).alias("claim"), verdict.alias("verdict"), (F.col("quality") == 1).alias("relevant"), F.when(F.col("source") != "src3", F.col("lang")).alias("truth"))


_C = f"cl AS (SELECT source AS query_id, 'claim ' || doc_id AS claim, {_V} AS verdict, quality = 1 AS relevant, CASE WHEN source <> 'src3' THEN lang END AS truth FROM documents JOIN labels USING (doc_id))"


@q(f"WITH {_C} SELECT query_id, round(avg(CASE WHEN relevant THEN 1.0 ELSE 0 END), 6) AS score FROM cl GROUP BY 1")
def a19_context_precision(spark, sf):
    return evaluate.context_precision(_claims(spark, sf)).select("query_id", F.round("score", 6).alias("score"))


@q(f"WITH {_C} SELECT query_id, round(CASE WHEN max(truth) IS NULL THEN 0.0 ELSE count(*) FILTER (WHERE verdict = 'supported') / count(claim) END, 6) AS score FROM cl GROUP BY 1")
def a20_context_recall(spark, sf):
    return evaluate.context_recall(_claims(spark, sf)).select("query_id", F.round("score", 6).alias("score"))


@q(f"WITH {_C} SELECT query_id, round(count(*) FILTER (WHERE verdict = 'supported') / count(*), 6) AS score, count(*) FILTER (WHERE verdict = 'supported') AS supported, count(*) FILTER (WHERE verdict = 'contradicted') AS contradicted, count(*) FILTER (WHERE verdict = 'neutral') AS neutral FROM cl GROUP BY 1")
def a21_faithfulness(spark, sf):
    """A21, A40."""
    return evaluate.claim_support(_claims(spark, sf)).select("query_id", F.round("score", 6).alias("score"), "supported", "contradicted", "neutral")


@q(f"WITH {_C} SELECT query_id, round((count(*) FILTER (WHERE verdict = 'supported') + 0.5 * count(*) FILTER (WHERE verdict = 'neutral')) / count(*), 6) AS score, count(*) FILTER (WHERE verdict = 'contradicted') > 0 AS hallucination FROM cl GROUP BY 1")
def a26_nli_lenient(spark, sf):
    label = F.when(F.col("verdict") == "supported", "entailment").when(F.col("verdict") == "contradicted", "contradiction").otherwise("neutral")
    return evaluate.nli(_claims(spark, sf).withColumn("label", label), strict=False).select("query_id", F.round("score", 6).alias("score"), "hallucination")


@q(f"WITH {_C} SELECT query_id, array_to_string(list(claim ORDER BY claim), ';') AS contradictions FROM cl WHERE verdict = 'contradicted' GROUP BY 1")
def a27_hallucinations(spark, sf):
    rows = _claims(spark, sf).withColumn("label", F.when(F.col("verdict") == "contradicted", "contradiction").otherwise("entailment"))
    return evaluate.hallucinations(rows).select("query_id", F.array_join("contradictions", ";").alias("contradictions"))


@q("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS query_id, round(max(list_cosine_similarity(a.e, b.e)), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1""")
def a22_answer_relevancy(spark, sf):
    e = t(spark, sf, "embeddings")
    a = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("x"))
    near = F.expr("label = __label and query_id <> vec_id")

    def meet(part):
        rows = e.join(F.broadcast(part), near).select("query_id", vec.cosine(F.col("x"), F.col("embedding")).alias("similarity"))
        return rows.groupBy("query_id").agg(F.max("similarity").alias("similarity"))

    rows = retrieval.in_blocks(a.withColumnRenamed("label", "__label"), "query_id", meet)
    return evaluate.answer_relevancy(rows).select("query_id", F.round("score", 6).alias("score"))


_M = f"WITH {_C}, m AS (SELECT query_id, 'context_precision' AS metric, avg(CASE WHEN relevant THEN 1.0 ELSE 0 END) AS score FROM cl GROUP BY 1 UNION ALL SELECT query_id, 'faithfulness', count(*) FILTER (WHERE verdict = 'supported') / count(*) FROM cl GROUP BY 1 UNION ALL SELECT query_id, 'other', 0.5 FROM cl GROUP BY 1)"


def _metrics(spark, sf):
    c = _claims(spark, sf)
    name = lambda df, n: df.select("query_id", F.lit(n).alias("metric"), "score")
    return name(evaluate.context_precision(c), "context_precision").unionByName(name(evaluate.claim_support(c), "faithfulness")).unionByName(c.select("query_id", F.lit("other").alias("metric"), F.lit(0.5).alias("score")).distinct())


@q(f"{_M}, w AS (SELECT *, CASE metric WHEN 'context_precision' THEN 0.2 WHEN 'faithfulness' THEN 0.3 ELSE 0.25 END::DOUBLE AS w FROM m) SELECT query_id, round(sum(w * score) / sum(w), 6) AS score FROM w GROUP BY 1")
def a23_ragas(spark, sf):
    return evaluate.ragas(_metrics(spark, sf)).select("query_id", F.round("score", 6).alias("score"))


@q(f"{_M}, w AS (SELECT *, CASE metric WHEN 'faithfulness' THEN 2 ELSE 1 END::DOUBLE AS w FROM m) SELECT query_id, round(sum(w * score) / sum(w), 6) AS score, sum(w * score) / sum(w) >= 0.7 AS passed FROM w GROUP BY 1")
def a24_composite(spark, sf):
    return evaluate.composite(_metrics(spark, sf), {"faithfulness": 2.0}).select("query_id", F.round("score", 6).alias("score"), "passed")


@q("SELECT event_id, round((value / 100 + value / 200 + 0.3) / 3, 6) AS overall, (value / 100 + value / 200 + 0.3) / 3 < 0.5 AS again, CASE WHEN value / 100 >= 0.7 THEN 'fully' WHEN value / 100 >= 0.4 THEN 'partially' ELSE 'not' END AS token, CASE WHEN value / 100 >= 0.8 THEN 'correct' WHEN value / 100 >= 0.4 THEN 'ambiguous' ELSE 'incorrect' END AS level, trim(concat_ws(' ', CASE WHEN value / 200 < 0.5 THEN 'Retrieve more relevant context.' END, CASE WHEN value / 100 < 0.5 THEN 'Ground the answer in the sources.' END)) AS advice FROM events")
def a25_self_rag(spark, sf):
    """A25, F43, F44, F45."""
    v = F.col("value") / 100
    overall, again = evaluate.self_rag(F.col("value") / 200, v, F.lit(0.3))
    return t(spark, sf, "events").select("event_id", F.round(overall, 6).alias("overall"), again.alias("again"), rules.support_token(v).alias("token"), rules.crag_level(v).alias("level"), rules.suggestions(v, F.col("value") / 200, F.lit(0.9)).alias("advice"))


@q(f"""{_BM25}, o AS (SELECT query_id, len(list_intersect(a, w)) / len(a) AS o FROM (SELECT query_id, list_distinct({SPLIT_LOW('b.text')}) AS a, {SPLIT_LOW('d.text')} AS w FROM bm25 JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id))),
g AS (SELECT query_id, avg(CASE WHEN o > 0.3 THEN 1.0 ELSE 0 END) AS ratio, avg(least(o * 2, 1)) AS mean FROM o GROUP BY 1)
SELECT query_id, round(ratio, 6) AS ratio, round(mean, 6) AS mean, CASE WHEN ratio >= 0.7 AND mean >= 0.7 THEN 'excellent' WHEN ratio >= 0.5 OR mean >= 0.5 THEN 'good' WHEN ratio >= 0.3 OR mean >= 0.3 THEN 'partial' ELSE 'poor' END AS quality FROM g""")
def a28_retrieval_quality(spark, sf):
    """A28, P6, Q18."""
    from ..plans.pipeline import PipelineBuilder

    docs, ask = t(spark, sf, "documents"), questions(spark, sf)
    hits = index(spark, sf).search(ask).join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    out = PipelineBuilder().build().assess(hits, ask)
    return out.select("query_id", F.round("ratio", 6).alias("ratio"), F.round("mean", 6).alias("mean"), "quality")


@q(f"""SELECT a.item_id, round(CASE WHEN len(list_intersect(x, y)) > 0 THEN 2 * len(list_intersect(x, y)) / (len(x) + len(y)) ELSE 0 END, 6) AS f1, contains(lower(a.text), lower(b.text[1:20])) AS holds
FROM (SELECT item_id, text, list_distinct({SPLIT_LOW('text')}) AS x FROM benchmark) a JOIN (SELECT item_id, text, list_distinct({SPLIT_LOW('text')}) AS y FROM benchmark) b ON b.item_id = a.item_id // 2""")
def a32_token_f1(spark, sf):
    """Token F1 and contained answers."""
    a = t(spark, sf, "benchmark")
    b = a.select(F.col("item_id").alias("other"), F.col("text").alias("truth"))
    return a.join(b, F.col("other") == F.floor(F.col("item_id") / 2)).select("item_id", F.round(evaluate.token_f1(F.col("text"), F.col("truth")), 6).alias("f1"), F.lower("text").contains(F.lower(F.substring("truth", 1, 20))).alias("holds"))


@q("SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(count(*) / sum(value), 6) AS per_second FROM events")
def a31_latency(spark, sf):
    return evaluate.latency(t(spark, sf, "events"), "value").select(*(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99", "per_second")))


@q("SELECT event_type, user_id % 10 AS label, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, arg_max(value, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS last FROM events GROUP BY 1, 2")
def a34_metric_summary(spark, sf):
    rows = t(spark, sf, "events").withColumn("label", F.col("user_id") % 10)
    return metrics.summary(rows, "event_type", "label").select("event_type", "label", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "most", "last")


@q("SELECT (SELECT count(*) FROM embeddings) AS entries, count(*) FILTER (WHERE event_type = 'click') AS hits, count(*) AS lookups, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS hit_rate FROM events")
def a35_cache_stats(spark, sf):
    return caching.stats(t(spark, sf, "embeddings"), t(spark, sf, "events").select((F.col("event_type") == "click").alias("hit"))).select("entries", "hits", "lookups", F.round("hit_rate", 6).alias("hit_rate"))


@q("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS entry_id, list_cosine_similarity(list_concat(a.e[2:], a.e[1:1]), b.e) AS s FROM e a, e b WHERE a.vec_id % 50 = 0)
SELECT query_id, min_by(entry_id, [-round(s, 9), entry_id::DOUBLE]) AS entry_id, round(max(s), 6) AS similarity FROM p WHERE s >= 0.2 GROUP BY 1""")
def j15_cache_probe(spark, sf):
    """The best of all entries above the threshold, for queries whose vectors are shifted by one place."""
    e = t(spark, sf, "embeddings")
    shifted = F.concat(F.slice("embedding", 2, F.size("embedding")), F.slice("embedding", 1, 1)).alias("embedding")
    out = caching.probe(e.select(F.col("vec_id").alias("entry_id"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), shifted), 0.2)
    return out.select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"))


@q("WITH c AS (SELECT DISTINCT sha256('m:' || text) AS k FROM documents SEMI JOIN labels USING (doc_id)) SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM (SELECT sha256('m:' || text) IN (FROM c) AS hit FROM documents)")
def j16_cache_split(spark, sf):
    """All texts by whether their embedding is cached; the cache holds those of labelled documents."""
    docs = t(spark, sf, "documents").withColumn("key", caching.embedding_key("m", F.col("text")))
    cache = docs.join(t(spark, sf, "labels"), "doc_id", "left_semi").select("key").distinct()
    hit, miss = caching.split(docs.select("doc_id", "key"), cache)
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return n(hit, "hits").crossJoin(n(miss, "misses"))


@q("SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 50)")
def j17_new_only(spark, sf):
    """Documents whose content no ingested one has."""
    from ..sources import files

    docs = t(spark, sf, "documents").withColumn("filename", F.lit("f"))
    known = docs.where("doc_id < 50").select(F.concat_ws("_", "filename", F.substring(F.md5("text"), 1, 8)).alias("source_file"))
    return files.new_only(docs, known).select("doc_id")


@q("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(ts) <= 86400 * 5")
def f40_ttl(spark, sf):
    e = t(spark, sf, "events").withColumn("created_at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return caching.alive(e, F.lit(1705708800.0), F.lit(86400.0 * 5)).select("event_id")


@q("SELECT event_id AS entry_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events) WHERE r > floor(n * 0.1)")
def o6_evict_oldest(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_id").alias("entry_id"), F.col("ts").alias("created_at"))
    return caching.evict_oldest(e).select("entry_id")


@q("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def w11_keep_last(spark, sf):
    return caching.keep_last(t(spark, sf, "events"), "user_id", "ts", 10, "event_id").select("user_id", "event_id")


@q("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10")
def w10_chat_history(spark, sf):
    """W10, T4 in batch form."""
    return caching.keep_last(t(spark, sf, "conversations"), "conv_id", "turn", 10, "turn").select("conv_id", "turn", "role")


_A = "(SELECT event_id, 'As shown [' || (event_id % 7) || '] and [2][' || (user_id % 9) || '].' AS a, CAST(user_id % 5 AS INT) AS n FROM events)"


@q(f"SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(a, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INT) - 1), lambda i: i >= 0 AND i < n)))::VARCHAR[], ',') AS cited FROM {_A}")
def f37_citations(spark, sf):
    a = F.concat(F.lit("As shown ["), (F.col("event_id") % 7).cast("string"), F.lit("] and [2]["), (F.col("user_id") % 9).cast("string"), F.lit("]."))
    return t(spark, sf, "events").select("event_id", F.array_join(F.transform(parse.citations(a, (F.col("user_id") % 5).cast("int")), lambda i: i.cast("string")), ",").alias("cited"))


_RESP = "(SELECT event_id, 'VERDICT: ' || CASE event_id % 4 WHEN 0 THEN 'Fully supported' WHEN 1 THEN 'not supported' WHEN 2 THEN 'unsupported' ELSE 'partially' END || chr(10) || CASE WHEN event_id % 3 = 0 THEN 'SCORE: ' || (event_id % 20 / 10.0)::DECIMAL(4,1) ELSE 'REASONING: none' END AS r FROM events)"


@q(f"""SELECT event_id, v AS verdict, coalesce(CASE WHEN event_id % 3 = 0 THEN least(1, (event_id % 20) / 10.0)::DOUBLE END, CASE v WHEN 'fully' THEN 0.9 WHEN 'not' THEN 0.1 ELSE 0.5 END::DOUBLE) AS score
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fully' WHEN 3 THEN 'partially' ELSE 'not' END AS v FROM events)""")
def f32_verdicts(spark, sf):
    """F32: verdict and score lines; 'not' and 'un-' are never taken for support."""
    e = F.col("event_id")
    line = F.when(e % 4 == 0, "Fully supported").when(e % 4 == 1, "not supported").when(e % 4 == 2, "unsupported").otherwise("partially")
    text = F.concat(F.lit("VERDICT: "), line, F.lit("\n"), F.when(e % 3 == 0, F.concat(F.lit("SCORE: "), ((e % 20) / 10.0).cast("string"))).otherwise("REASONING: none"))
    return t(spark, sf, "events").select("event_id", parse.verdict(text).alias("verdict"), parse.verdict_score(text).alias("score"))


@q("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' ELSE 'neutral' END AS label, event_id % 4 = 0 AS yes FROM events")
def f34_support(spark, sf):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, "Supported by [1]").when(e % 4 == 1, "contradicted").when(e % 4 == 2, "Unsupported").otherwise("not supported")
    said = F.when(e % 4 == 0, "Yes, it is").otherwise("eyes only")
    return t(spark, sf, "events").select("event_id", parse.support(text).alias("label"), parse.yes(said).alias("yes"))


@q("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f36_json(spark, sf):
    text = F.concat(F.lit("Here it is:\n"), "props", F.lit("\nDone."))
    return t(spark, sf, "events").select("event_id", parse.json_object(text, "k bigint")["k"].alias("k"))


@q(r"""SELECT conv_id, turn, CAST(len(c) AS BIGINT) AS n, md5(array_to_string(c, '|')) AS m FROM (
SELECT conv_id, turn, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: regexp_replace(x, '^[0-9.\-•) ]+', '')), lambda x: length(x) > 10)[1:20] AS c FROM conversations)""")
def f31_claims(spark, sf):
    c = parse.claims(F.col("text"))
    return t(spark, sf, "conversations").select("conv_id", "turn", F.size(c).cast("long").alias("n"), F.md5(F.array_join(c, "|")).alias("m"))


@q(r"SELECT event_id, least(1, greatest(0, coalesce(TRY_CAST(regexp_extract(props, '(-?\d+(?:\.\d+)?)', 1) AS DOUBLE), 0.5))) AS x FROM events")
def f35_numbers(spark, sf):
    return t(spark, sf, "events").select("event_id", parse.first_number(F.col("props"), 0.5).alias("x"))


@q(f"""SELECT item_id AS query_id, CASE WHEN n <= 3 THEN false WHEN f THEN false WHEN c THEN true ELSE n > 5 END AS hyde
FROM (SELECT item_id, len({WORDS('text')}) AS n, starts_with(lower(text), 'what is') OR starts_with(lower(text), 'who is') OR starts_with(lower(text), 'when was') OR starts_with(lower(text), 'where is') AS f,
starts_with(lower(text), 'how do') OR starts_with(lower(text), 'how can') OR starts_with(lower(text), 'why does') OR starts_with(lower(text), 'explain') OR starts_with(lower(text), 'describe') AS c
FROM (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'What is ' || text WHEN 1 THEN 'how do ' || text WHEN 2 THEN 'two words' ELSE text END AS text FROM benchmark))""")
def f26_adaptive(spark, sf):
    i = F.col("item_id")
    text = F.when(i % 5 == 0, F.concat(F.lit("What is "), "text")).when(i % 5 == 1, F.concat(F.lit("how do "), "text")).when(i % 5 == 2, "two words").otherwise(F.col("text"))
    return t(spark, sf, "benchmark").select(i.alias("query_id"), rules.use_hypothetical(text).alias("hyde"))


@q("""SELECT event_id, CASE k WHEN 0 THEN 'conversational' WHEN 1 THEN 'procedural' WHEN 2 THEN 'comparison' WHEN 3 THEN 'analytical' ELSE 'factual' END AS type, CASE k WHEN 0 THEN 'none' WHEN 2 THEN 'multi_query' WHEN 3 THEN 'hyde' ELSE 'direct' END AS strategy, CASE k WHEN 0 THEN 0 WHEN 2 THEN 15 WHEN 3 THEN 12 ELSE 10 END AS top_k, k IN (1, 3) AS question, k = 2 AS comparison
FROM (SELECT event_id, event_id % 5 AS k FROM events)""")
def f27_routing(spark, sf):
    """routes and query features."""
    k = F.col("event_id") % 5
    text = F.when(k == 0, "Hello there").when(k == 1, "how to open it").when(k == 2, "compare a versus b").when(k == 3, "why so").otherwise("the name of it")
    r, f = rules.route(text), rules.query_features(text)
    return t(spark, sf, "events").select("event_id", r["type"].alias("type"), r["strategy"].alias("strategy"), r["top_k"].alias("top_k"), f["question"].alias("question"), f["comparison"].alias("comparison"))


@q("SELECT event_id, least(pow(2, event_id % 9), 60)::DOUBLE AS wait, round(least((user_id % 8) / 5, 1) * 0.8, 6) AS confidence FROM events")
def f46_confidence(spark, sf):
    """F46, F47."""
    return t(spark, sf, "events").select("event_id", rules.backoff_seconds((F.col("event_id") % 9).cast("double")).alias("wait"), F.round(rules.confidence(F.col("user_id") % 8), 6).alias("confidence"))


@q("""SELECT item_id AS query_id, md5('Answer the question from the 3 sources below and cite them as [n].' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:') AS prompt, 'Find documents that answer this question: ' || text[1:10] AS instruction FROM benchmark""")
def f41_prompts(spark, sf):
    """F41, F48, X4."""
    p = providers.prompt("answer", sources=F.lit(3), context=F.col("text"), query=F.col("text"))
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.md5(p).alias("prompt"), providers.instruct("query", F.substring("text", 1, 10)).alias("instruction"))


@q(r"SELECT doc_id, text[1:500] AS head, md5('[Context: ' || lang || ']' || chr(10) || chr(10) || text) AS contextual FROM documents")
def p9_payload(spark, sf):
    """P9, F16."""
    from ..operators import chunking

    return t(spark, sf, "documents").select("doc_id", F.substring("text", 1, 500).alias("head"), F.md5(chunking.contextual(F.col("text"), F.col("lang"))).alias("contextual"))


@q()
def f29_variations(spark, sf):
    """a recorded answer with numbering, boilerplate, quotes and repeats."""
    answer = F.concat(F.lit("Here are rewrites:\n1. "), F.lower("text"), F.lit("\n2. \"words about "), F.substring("text", 1, 12), F.lit("\"\n- abc\nQuery: more on it\n"))
    return t(spark, sf, "benchmark").select("item_id", parse.variations(F.substring("text", 1, 20), answer).alias("variations"))


@q()
def q26_pipeline(spark, sf):
    """Chunk, embed, retrieve, fuse, rerank, answer, cite, with the offline providers."""
    from ..plans.pipeline import PipelineBuilder

    p = PipelineBuilder().with_config(top_k=5).build()
    chunks = p.ingest(t(spark, sf, "documents"))
    return p.query(chunks, questions(spark, sf))


@q()
def q10_summary_tree(spark, sf):
    """A tree of summaries over the chunks of every document, short ones included."""
    from ..operators import chunking, cluster

    docs = t(spark, sf, "documents")
    return cluster.build_tree(chunking.sentence_chunks(docs, least=1), 2)


@q()
def a16_kmeans(spark, sf):
    from ..operators import cluster

    return cluster.kmeans(t(spark, sf, "embeddings"), 10)


@q()
def a17_mixture(spark, sf):
    from ..operators import cluster

    e = t(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), "embedding")
    return cluster.mixture_groups(e, "label")


def _tree(spark, sf):
    """A small deterministic tree: documents are leaves, a source's first sentences its summary."""
    docs = t(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), F.lit(0).alias("level"), F.col("source").alias("parent_id"), F.lit(False).alias("is_summary"), F.col("text").alias("content"))
    work = Workspace(spark, "sources")
    first = work.table("first", docs.groupBy("parent_id").agg(F.min(F.when(F.col("content").isNotNull(), F.col("doc_id"))).alias("first")))
    met = docs.select("doc_id", F.col("parent_id").alias("p"), "content").where("content is not null").join(first, F.col("p").eqNullSafe(F.col("parent_id")) & (F.col("doc_id") == F.col("first")))
    text = met.select("parent_id", "content").unionByName(first.where("first is null").select("parent_id", F.lit(None).cast("string").alias("content")))
    up = work.table("summaries", text.groupBy("parent_id").agg(F.max("content").alias("content")))
    up = up.select(F.lit(-1).cast("long").alias("doc_id"), F.col("parent_id").alias("node_id"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("is_summary"), "content")
    return docs.unionByName(up)


def _node_hits(spark, sf, nodes):
    """Written, as both kinds of nodes are picked from it."""
    hits = retrieval.bm25(nodes, questions(spark, sf), 30, "node_id", "content").select("query_id", F.col("doc_id").alias("node_id"), "score")
    return Workspace(spark, "node-hits").table("hits", hits)


_NODES = "SELECT 'd' || doc_id AS id, text, 0 AS level, source AS parent, doc_id FROM documents UNION ALL SELECT source, min_by(text, doc_id), 1, NULL, -1 FROM documents GROUP BY 1"
_NODE_HITS = f"WITH node AS ({_NODES}), {ranked_sql('SELECT id, text FROM node', _ASK, 30)}, h AS (SELECT query_id, id, s, rk, level, parent, text FROM r JOIN node USING (id))"


@q(f"""{_NODE_HITS}, one AS (SELECT *, row_number() OVER (PARTITION BY query_id, text[1:100] ORDER BY rk, id) AS n FROM h WHERE rk <= 20),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level, round(s, 9) DESC, id) AS rank FROM one WHERE n = 1)
SELECT query_id, id AS node_id, level, round(s, 6) AS score, rank FROM o WHERE rank <= 10""")
def q9_tree_collapsed(spark, sf):
    from ..operators import trees

    n = _tree(spark, sf)
    return trees.collapsed(_node_hits(spark, sf, n), n).select("query_id", "node_id", "level", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@q(f"""{_NODE_HITS}, sm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS r1 FROM h WHERE level = 1 QUALIFY r1 <= 3),
lf AS (SELECT h.query_id, h.id, h.s, row_number() OVER (PARTITION BY h.query_id ORDER BY CASE WHEN sm.id IS NULL THEN 0 ELSE 1 END DESC, round(h.s, 9) DESC, h.id) AS r2 FROM h LEFT JOIN sm ON sm.query_id = h.query_id AND sm.id = h.parent WHERE h.level = 0 QUALIFY r2 <= 6)
SELECT query_id, id AS node_id, round(s, 6) AS score, 'summary' AS kind, r1 AS rank FROM sm UNION ALL SELECT query_id, id, round(s, 6), 'leaf', r2 FROM lf""")
def q9_tree_traversal(spark, sf):
    from ..operators import trees

    n = _tree(spark, sf)
    return trees.traversal(_node_hits(spark, sf, n), n).select("query_id", "node_id", F.round("score", 6).alias("score"), "kind", F.col("rank").cast("long").alias("rank"))


@q(f"{_NODE_HITS} SELECT query_id, id AS node_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM h WHERE level = 1 QUALIFY rank <= 3")
def q9_tree_level(spark, sf):
    from ..operators import trees

    n = _tree(spark, sf)
    return trees.at_level(_node_hits(spark, sf, n), n, 1, 3).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@q("SELECT 'd' || d.doc_id AS node_id, md5('[Summary: ' || s.text[1:200] || ']' || chr(10) || chr(10) || d.text) AS m FROM documents d JOIN (SELECT source, min_by(text, doc_id) AS text FROM documents GROUP BY 1) s USING (source)")
def j6_leaf_context(spark, sf):
    from ..operators import trees

    n = _tree(spark, sf)
    return trees.with_parents(n.where("level = 0").select("node_id"), n).select("node_id", F.md5("content").alias("m"))


@q("SELECT doc_id, md5(concat_ws(chr(10) || chr(10), '[Parent Context]' || chr(10) || source, '[Content]' || chr(10) || text, CASE WHEN doc_id % 2 = 0 THEN '[Details]' || chr(10) || lang END)) AS m FROM documents")
def f12_render_context(spark, sf):
    from ..operators import chunking

    details = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return t(spark, sf, "documents").select("doc_id", F.md5(chunking.render_context(F.col("source"), F.col("text"), details)).alias("m"))


@q("""SELECT doc_id, md5(substr(text, greatest(p - 30, 1), p - greatest(p - 30, 1)) || '[CHUNK]' || c || '[/CHUNK]' || substr(text, p + length(c), 30)) AS m
FROM (SELECT doc_id, text, c, strpos(text, c) AS p FROM (SELECT doc_id, text, CASE WHEN length(text) > 60 THEN substr(text, 41, 20) ELSE text END AS c FROM documents))""")
def f49_marked_chunk(spark, sf):
    from ..operators import chunking

    chunk = F.when(F.length("text") > 60, F.substring("text", 41, 20)).otherwise(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.md5(chunking.marked(F.col("text"), chunk, 30)).alias("m"))


@q()
def q6_expanded(spark, sf):
    """Q5, Q6: every query with a rewrite (its first half), searched at once and fused."""
    from ..plans.pipeline import PipelineBuilder, expanded

    p = PipelineBuilder().with_options(rerank=False).build()
    ask = questions(spark, sf)
    half = ask.select("query_id", F.lit(1).alias("n"), F.substring(F.col("query"), F.lit(1), (F.length("query") / 2).cast("int")).alias("query"))
    return expanded(p, p.ingest(t(spark, sf, "documents")), ask, half)


@q(f"""{_BM25}, x AS (SELECT query_id, doc_id AS chunk_id, rk, len(list_intersect(list_distinct(regexp_extract_all(b.text, '(?s).')), list_distinct(regexp_extract_all(d.text, '(?s).')))) AS s FROM bm25 JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id))
SELECT query_id, chunk_id, rk AS original_rank, s::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rk, chunk_id) AS rank FROM x""")
def x6_scored_rerank(spark, sf):
    """Hits of BM25 by a pair scorer in Arrow batches (here: shared letters)."""
    from ..operators import rerank

    docs, ask = t(spark, sf, "documents"), questions(spark, sf)
    hits = index(spark, sf).search(ask).join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").withColumnRenamed("doc_id", "chunk_id")
    return rerank.scored(hits, ask, lambda: lambda a, b: [len(set(x) & set(y)) for x, y in zip(a, b, strict=True)]).select("query_id", "chunk_id", F.col("original_rank").cast("long").alias("original_rank"), "score", F.col("rank").cast("long").alias("rank"))
