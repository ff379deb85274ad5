"""Stores, ingestion, reports and late or contextual chunks."""

from pyspark.sql import functions as F

from ..functions import metadata, parse
from ..operators import chunking, cluster, contextual, late
from ..session import Workspace
from .base import q, t
from .chunks import _PACKS


@q(f"""WITH RECURSIVE {_PACKS}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1)
SELECT 'file' || d.doc_id AS source, CASE WHEN doc_id % 10 = 3 THEN 'failed' ELSE 'ingested' END AS status, CASE WHEN doc_id % 10 = 3 THEN 0 ELSE coalesce(n.n, 0) END AS chunks, CASE WHEN doc_id % 10 = 3 THEN 'unreadable' END AS error FROM documents d LEFT JOIN n USING (doc_id)""")
def s15_batch_ingest(spark, sf):
    """Every document chunked, embedded and stored; those marked unreadable fail alone."""
    from ..plans.ingest import BatchIngester
    from ..sources.vector_table import VectorTable

    i = F.col("doc_id")
    docs = t(spark, sf, "documents").select(F.concat(F.lit("file"), i.cast("string")).alias("source"), F.concat(F.lit("f"), i.cast("string")).alias("filename"), "text", F.when(i % 10 == 3, "unreadable").alias("error"))
    return BatchIngester(VectorTable(spark, f"{Workspace(spark, 'ingested').base}/chunks")).ingest(docs)


@q("SELECT count(DISTINCT sha256('hash:' || text)) AS cached, count(*) AS vectors, count(*) AS again FROM documents")
def s19_embedding_cache(spark, sf):
    """Texts embedded through a stored cache, twice; the second time nothing is embedded."""
    from ..sources.embedding_cache import EmbeddingCache

    docs = t(spark, sf, "documents")
    cache = EmbeddingCache(spark, f"{Workspace(spark, 'embeddings').base}/hash", "hash")
    n = cache.embed(docs, "doc_id", "text", cluster.hash_embed)

    def refuse(rows, key, text):
        raise AssertionError("everything is cached")

    again = cache.embed(docs, "doc_id", "text", refuse)
    one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return one(cache.table.scan(), "cached").crossJoin(one(n, "vectors")).crossJoin(one(again, "again"))


@q("""SELECT 'hotpotqa' AS name, 2 AS rows, 5 AS contexts UNION ALL SELECT 'natural_questions', 2, 2 UNION ALL SELECT 'triviaqa', 2, 2""")
def s20_benchmarks(spark, sf):
    from ..sources.datasets import SAMPLES, load_benchmark

    out = None
    for name in sorted(SAMPLES):
        part = load_benchmark(spark, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).cast("int").alias("rows"), F.sum(F.size("contexts")).cast("int").alias("contexts"))
        out = part if out is None else out.unionByName(part)
    return out


@q("""SELECT '# Documents by language' || chr(10) || chr(10) || '| lang | documents |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' |', chr(10) ORDER BY lang) AS report FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)""")
def s21_report(spark, sf):
    from ..sources.reports import markdown

    return markdown(t(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents")), "Documents by language", "lang")


@q("SELECT doc_id, 4::BIGINT AS fields, lang, source, NULL::VARCHAR AS content FROM documents")
def p10_payload(spark, sf):
    """P10: metadata flattened into the payload beside the chunk's own fields, and taken out again."""
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("content"), F.lit("hidden"))
    rows = t(spark, sf, "documents").select("doc_id", metadata.flatten(m, doc_id=F.col("doc_id"), content=F.col("text")).alias("p"))
    back = metadata.unflatten(F.col("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("fields"), back["lang"].alias("lang"), back["source"].alias("source"), back["content"].alias("content"))


_DIM = "('0x' || md5(w)[{0}:{1}])::INT / 255.0::DOUBLE - 0.5::DOUBLE".format


@q(f"""WITH tok AS (SELECT doc_id, w0 AS raw, lower(w0) AS w, i FROM (SELECT doc_id, unnest(ts) AS w0, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS ts FROM documents))),
v AS (SELECT doc_id, i, {_DIM(1, 2)} AS a, {_DIM(3, 4)} AS b FROM tok),
c AS (SELECT doc_id, i, avg(a) OVER w AS a, avg(b) OVER w AS b FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT doc_id, count(*) AS tokens, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM c GROUP BY 1""")
def f15_late_whole(spark, sf):
    """Token vectors in context, pooled over the whole of each text."""
    docs = t(spark, sf, "documents")
    spans = docs.select("doc_id", F.lit(0).alias("position"), F.lit(0).alias("begin"), F.length("text").alias("end"))
    out = late.late_chunks(docs, spans).where("tokens > 0")
    return out.select("doc_id", "tokens", F.round(F.get("embedding", F.lit(0)), 6).alias("a"), F.round(F.get("embedding", F.lit(1)), 6).alias("b"))


@q("""SELECT doc_id, begin // 462 AS position, count(*) FILTER (WHERE inside) AS tokens FROM (
SELECT doc_id, begin, regexp_matches(x, '.') AS inside FROM (SELECT doc_id, begin, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS x FROM (
SELECT doc_id, begin, regexp_extract_all(regexp_replace(regexp_replace(text[begin + 1 : least(begin + 512, length(text))], CASE WHEN begin > 0 AND regexp_matches(text[begin : begin + 1], '^[\\p{L}\\p{N}_]{2}$') THEN '^[\\p{L}\\p{N}_]+' ELSE '^$' END, ''), CASE WHEN begin + 512 < length(text) AND regexp_matches(text[begin + 512 : begin + 513], '^[\\p{L}\\p{N}_]{2}$') THEN '[\\p{L}\\p{N}_]+$' ELSE '^$' END, ''), '[\\p{L}\\p{N}_]+') AS ts
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 462)) AS begin FROM documents WHERE length(text) > 0)))) GROUP BY 1, 2""")
def f15_late_chunks(spark, sf):
    """how many whole tokens every fixed window pools."""
    docs = t(spark, sf, "documents")
    spans = chunking.fixed_chunks(docs).select("doc_id", "position", "begin", "end")
    return late.late_chunks(docs, spans).select("doc_id", F.col("position").cast("long").alias("position"), "tokens")


@q(f"WITH RECURSIVE {_PACKS} SELECT doc_id, CAST(position AS BIGINT) AS position, CASE WHEN position % 4 = 3 THEN 'Part of the document.' ELSE 'about ' || content[1:10] END AS header FROM (SELECT doc_id, position, regexp_replace(content, '\\s', '_', 'g') AS content FROM chunks)")
def f17_contextual_batches(spark, sf):
    """prompts for batches of chunks, recorded answers (every fourth line is missing) read back."""
    chunks = chunking.sentence_chunks(t(spark, sf, "documents")).withColumn("content", F.regexp_replace("content", r"\s", "_"))
    asked = contextual.prompts(chunks)
    line = F.when(F.col("position") % 4 != 3, F.concat(F.lit("CHUNK_"), (F.col("position") % 20).cast("string"), F.lit(": about "), F.substring("content", 1, 10)))
    said = chunks.withColumn("batch", F.floor(F.col("position") / 20).cast("int")).groupBy("doc_id", "batch").agg(F.array_join(F.collect_list(line), "\n").alias("response"))
    answers = asked.select("doc_id", "batch").join(said, ["doc_id", "batch"])
    return contextual.headers(answers, chunks).select("doc_id", F.col("position").cast("long").alias("position"), "header")


@q("""SELECT event_id, n, CASE WHEN n = 2 THEN 'neutral' WHEN (event_id + n) % 3 = 0 THEN 'entailment' WHEN (event_id + n) % 3 = 1 THEN 'contradiction' ELSE 'neutral' END AS label, CASE WHEN n = 2 THEN 0.5 ELSE n / 4.0 END::DOUBLE AS confidence, CASE WHEN n = 2 THEN '' ELSE 'as in ' || event_type END AS evidence FROM events, range(1, 5) r(n)""")
def f33_nli_batch(spark, sf):
    """four claims judged in one answer, of which the second line is missing."""
    e = F.col("event_id")
    label = lambda n: F.when((e + n) % 3 == 0, "ENTAILMENT").when((e + n) % 3 == 1, "Contradicted").otherwise("unclear")
    line = lambda n: F.concat(F.lit(f"CLAIM_{n}: "), label(n), F.lit(f" | {n / 4} | as in "), "event_type")
    answer = F.concat_ws("\n", line(1), line(3), line(4))
    rows = t(spark, sf, "events").select("event_id", F.posexplode(parse.nli_batch(answer, F.lit(4))).alias("i", "x"))
    return rows.select("event_id", (F.col("i") + 1).cast("long").alias("n"), "x.*")


@q("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'entailment' WHEN 1 THEN 'contradiction' ELSE 'neutral' END AS label, CASE WHEN event_id % 2 = 0 THEN least(1, (event_id % 13) / 10.0) ELSE 0.5 END::DOUBLE AS confidence, event_type AS evidence FROM events")
def f33_nli(spark, sf):
    e = F.col("event_id")
    label = F.when(e % 3 == 0, "Entailment").when(e % 3 == 1, "contradiction").otherwise("none")
    text = F.concat(F.lit("LABEL: "), label, F.lit("\n"), F.when(e % 2 == 0, F.concat(F.lit("CONFIDENCE: "), ((e % 13) / 10.0).cast("string"))).otherwise("CONFIDENCE: high"), F.lit("\nEVIDENCE: "), "event_type")
    return t(spark, sf, "events").select("event_id", parse.nli(text).alias("x")).select("event_id", "x.*")


_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')".format


def _cuts_sql(end, size: int, back: int) -> str:
    """Pieces of every text whose ends follow from their begins by `end`; blank ones don't count."""
    return f"""WITH RECURSIVE cut AS (
  SELECT doc_id, 0 AS i, 0 AS a, {end.replace('@', '0')} AS b FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, i + 1, na, {end.replace('@', 'na')} FROM (SELECT c.doc_id, i, greatest(b - {back}, a + 1) AS na, text FROM cut c JOIN documents USING (doc_id) WHERE b < length(text))),
piece AS (SELECT doc_id, i, {_TRIM('text[a + 1 : b]')} AS x FROM cut JOIN documents USING (doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position, md5(x) AS m FROM piece WHERE x <> ''"""


_SOFT = "CASE WHEN @ + 512 >= length(text) THEN length(text) WHEN strpos(reverse(text[@ + 410 : @ + 512]), ' ') BETWEEN 1 AND 102 THEN @ + 513 - strpos(reverse(text[@ + 410 : @ + 512]), ' ') ELSE @ + 512 END"
_LAST = lambda p, n: f"CASE WHEN strpos(reverse(text[@ + 1351 : @ + 1500]), {p}) > 0 THEN @ + 1500 - strpos(reverse(text[@ + 1351 : @ + 1500]), {p}) - {n - 1} ELSE -1 END"
_FALL = f"greatest({_LAST(chr(39) + ' .' + chr(39), 2)}, {_LAST(chr(39) + ' !' + chr(39), 2)}, {_LAST(chr(39) + ' ?' + chr(39), 2)}, {_LAST('chr(10)', 1)})"
_FALLBACK = f"CASE WHEN @ + 1500 >= length(text) THEN length(text) WHEN {_FALL} > @ THEN {_FALL} + 1 ELSE @ + 1500 END"


def _digest(chunks):
    return chunks.select("doc_id", F.col("position").cast("long").alias("position"), F.md5("content").alias("m"))


@q(_cuts_sql(_SOFT, 512, 50))
def f5_soft_chunks(spark, sf):
    return _digest(chunking.soft_chunks(t(spark, sf, "documents")))


@q(_cuts_sql(_FALLBACK, 1500, 150))
def f18_fallback_chunks(spark, sf):
    return _digest(chunking.fallback_chunks(t(spark, sf, "documents")))
