"""Chunking, hierarchy and compression."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, metrics, rerank
from .base import SENTENCES, SPLIT_LOW, q, t
from .lexical import _BM25

# Greedy sentence packs in SQL: a fold by a recursive query, one sentence a step.
_PACKS = f"""s AS (SELECT doc_id, {SENTENCES('text')} AS s FROM documents),
fold AS (
  SELECT doc_id, s, 0 AS i, 0 AS len, CAST([] AS VARCHAR[]) AS cur, CAST([] AS VARCHAR[][]) AS done FROM s
  UNION ALL
  SELECT doc_id, s, i + 1,
    CASE WHEN len + length(s[i+1]) > 512 AND len(cur) > 0 THEN length(cur[-1]) + length(s[i+1]) ELSE len + length(s[i+1]) END,
    CASE WHEN len + length(s[i+1]) > 512 AND len(cur) > 0 THEN [cur[-1], s[i+1]] ELSE list_append(cur, s[i+1]) END,
    CASE WHEN len + length(s[i+1]) > 512 AND len(cur) > 0 THEN list_append(done, cur) ELSE done END
  FROM fold WHERE i < len(s)),
packs AS (SELECT doc_id, CASE WHEN length(array_to_string(cur, ' ')) >= 100 THEN list_append(done, cur) ELSE done END AS p FROM fold WHERE i = len(s)),
chunks AS (SELECT doc_id, unnest(list_transform(p, lambda x: array_to_string(x, ' '))) AS content, generate_subscripts(p, 1) - 1 AS position FROM packs)"""


def _chunks(spark, sf):
    return chunking.sentence_chunks(t(spark, sf, "documents"))


@q(f"WITH RECURSIVE {_PACKS} SELECT doc_id, CAST(position AS BIGINT) AS position, md5(content) AS m, length(content) AS n FROM chunks")
def f6_sentence_chunks(spark, sf):
    return _chunks(spark, sf).select("doc_id", F.col("position").cast("long").alias("position"), F.md5("content").alias("m"), F.length("content").cast("long").alias("n"))


@q(f"WITH RECURSIVE {_PACKS} SELECT doc_id, count(*) AS chunks, round(avg(length(content)), 6) AS mean_chars, min(length(content)) AS least_chars, max(length(content)) AS most_chars FROM chunks GROUP BY 1")
def a30_chunk_stats(spark, sf):
    return metrics.chunk_stats(_chunks(spark, sf)).select("doc_id", "chunks", F.round("mean_chars", 6).alias("mean_chars"), F.col("least_chars").cast("long").alias("least_chars"), F.col("most_chars").cast("long").alias("most_chars"))


@q("""SELECT doc_id, CAST(begin // 462 AS BIGINT) AS position, CAST(begin AS BIGINT) AS begin, CAST(least(begin + 512, length(text)) AS BIGINT) AS "end", md5(text[begin + 1 : begin + 512]) AS m
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 462)) AS begin FROM documents WHERE length(text) > 0)""")
def f5_fixed_chunks(spark, sf):
    x = chunking.fixed_chunks(t(spark, sf, "documents"))
    return x.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("position", "begin", "end")), F.md5("content").alias("m"))


@q()
def f7_recursive_chunks(spark, sf):
    return chunking.recursive_chunks(t(spark, sf, "documents"))


@q()
def f8_token_chunks(spark, sf):
    return chunking.token_chunks(t(spark, sf, "documents"))


def _level_sql(n: int, source: str, size: int) -> str:
    """One level of a hierarchy: packs without overlap of at least 20 characters of texts (k: their key), and their ids."""
    full = f"len + length(s[i+1]) > {size} AND len(cur) > 0"
    return f"""s{n} AS (SELECT doc_id, up, {SENTENCES('text')} AS s FROM ({source})),
fold{n} AS (
  SELECT doc_id, up, s, 0 AS i, 0 AS len, CAST([] AS VARCHAR[]) AS cur, CAST([] AS VARCHAR[][]) AS done FROM s{n}
  UNION ALL SELECT doc_id, up, s, i + 1, CASE WHEN {full} THEN length(s[i+1]) ELSE len + length(s[i+1]) END, CASE WHEN {full} THEN [s[i+1]] ELSE list_append(cur, s[i+1]) END, CASE WHEN {full} THEN list_append(done, cur) ELSE done END
  FROM fold{n} WHERE i < len(s)),
p{n} AS (SELECT doc_id, up, CASE WHEN length(array_to_string(cur, ' ')) >= 20 THEN list_append(done, cur) ELSE done END AS p FROM fold{n} WHERE i = len(s)),
c{n} AS (SELECT doc_id, up, unnest(list_transform(p, lambda x: array_to_string(x, ' '))) AS content, generate_subscripts(p, 1) - 1 AS position FROM p{n}),
l{n} AS (SELECT doc_id, {n} AS level, up, position, content, sha256(doc_id || chr(1) || 'level{n}' || chr(1) || up || chr(1) || position) AS chunk_id FROM c{n})"""


@q(f"""WITH RECURSIVE {_level_sql(0, "SELECT doc_id, '' AS up, text FROM documents", 2000)}, {_level_sql(1, "SELECT doc_id, chunk_id AS up, content AS text FROM l0", 512)}, {_level_sql(2, "SELECT doc_id, chunk_id AS up, content AS text FROM l1", 128)}
SELECT doc_id, level::BIGINT AS level, position::BIGINT AS position, chunk_id, nullif(up, '') AS parent_id, md5(content) AS m FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2)""")
def f11_hierarchical_chunks(spark, sf):
    out = chunking.hierarchical_chunks(t(spark, sf, "documents"))
    return out.select("doc_id", F.col("level").cast("long").alias("level"), F.col("position").cast("long").alias("position"), "chunk_id", "parent_id", F.md5("content").alias("m"))


_TREE_MD = "CASE WHEN position % 4 = 0 THEN '# Part ' || position // 4 WHEN position % 4 = 2 THEN '## Piece ' || position ELSE content END"


@q(f"""WITH RECURSIVE {_PACKS},
lines AS (SELECT doc_id, position, content, position // 4 AS p1, CASE WHEN position % 4 = 3 THEN position - 1 END AS p2 FROM chunks)
SELECT doc_id, 'Part ' || CAST(p1 AS VARCHAR) || CASE WHEN p2 IS NULL THEN '' ELSE ' > Piece ' || CAST(p2 AS VARCHAR) END AS header_path, md5(trim(replace(content, chr(10), ' '))) AS m
FROM lines WHERE position % 2 = 1 AND length(trim(replace(content, chr(10), ' '))) >= 50""")
def f13_markdown_chunks(spark, sf):
    """Header paths of a Markdown text made of a document's chunks: every second one becomes a heading."""
    p = F.col("position")
    line = F.when(p % 4 == 0, F.concat(F.lit("# Part "), F.floor(p / 4).cast("string"))).when(p % 4 == 2, F.concat(F.lit("## Piece "), p.cast("string"))).otherwise(F.replace("content", F.lit("\n"), F.lit(" ")))
    docs = _chunks(spark, sf).select("doc_id", "position", line.alias("line")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return chunking.markdown_chunks(docs).select("doc_id", "header_path", F.md5("content").alias("m"))


@q(f"""WITH RECURSIVE {_PACKS}, h AS (SELECT doc_id, doc_id * 1000 + position AS chunk_id, doc_id * 1000 + position // 3 * 3 AS parent, row_number() OVER (PARTITION BY doc_id ORDER BY md5(content), position) AS rk FROM chunks)
SELECT doc_id AS query_id, parent AS chunk_id, min(rk) AS first_rank, count(*) AS children, row_number() OVER (PARTITION BY doc_id ORDER BY min(rk), parent) AS rank FROM h GROUP BY 1, 2""")
def j5_parents(spark, sf):
    """Hits to distinct parents; chunks in threes share a parent."""
    from pyspark.sql import Window

    c = _chunks(spark, sf).select("doc_id", "position", (F.col("doc_id") * 1000 + F.col("position")).alias("chunk_id"), (F.col("doc_id") * 1000 + F.floor(F.col("position") / 3) * 3).alias("parent_id"), "content")
    hits = c.select(F.col("doc_id").alias("query_id"), "chunk_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5("content"), "position")).alias("rank"))
    out = chunking.parents(hits, c)
    return out.select("query_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("first_rank").cast("long").alias("first_rank"), "children", F.col("rank").cast("long").alias("rank"))


@q(f"""WITH RECURSIVE {_PACKS} SELECT doc_id * 1000 + position // 3 * 3 AS chunk_id, string_agg(CAST(doc_id * 1000 + position AS VARCHAR), ',' ORDER BY position) AS kids FROM chunks GROUP BY 1, doc_id""")
def j4_children(spark, sf):
    c = _chunks(spark, sf).select("position", (F.col("doc_id") * 1000 + F.col("position")).alias("chunk_id"), (F.col("doc_id") * 1000 + F.floor(F.col("position") / 3) * 3).cast("long").alias("parent_id"))
    return chunking.children(c).select("chunk_id", F.array_join(F.transform("child_ids", lambda x: x.cast("string")), ",").alias("kids"))


@q(f"""WITH RECURSIVE {_PACKS}, r AS (SELECT doc_id AS query_id, position, position + 1 AS rk, sum(length(content)) OVER (PARTITION BY doc_id ORDER BY position) AS total FROM chunks)
SELECT query_id, rk AS rank, CAST(total AS BIGINT) AS total FROM r WHERE total <= 2000""")
def o5_context_window(spark, sf):
    c = _chunks(spark, sf).withColumn("rank", F.col("position") + 1)
    out = chunking.context_window(c.select(F.col("doc_id").alias("query_id"), "chunk_id", "rank"), c, 500)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "total")


def _sentences(spark, sf):
    """Sentences with small deterministic vectors: character-class counts."""
    rows = t(spark, sf, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    n = lambda p: F.length(F.regexp_replace("sentence", f"[^{p}]", "")).cast("double")
    return rows.withColumn("embedding", F.array(n("a"), n("e"), n("i"), n("o"), n("t")))


_SEM = f"""sn AS (SELECT doc_id, unnest({SENTENCES('text')}) AS x, generate_subscripts({SENTENCES('text')}, 1) - 1 AS pos FROM documents),
ev AS (SELECT *, [length(regexp_replace(x, '[^a]', '', 'g')), length(regexp_replace(x, '[^e]', '', 'g')), length(regexp_replace(x, '[^i]', '', 'g')), length(regexp_replace(x, '[^o]', '', 'g')), length(regexp_replace(x, '[^t]', '', 'g'))]::DOUBLE[] AS e FROM sn),
sim AS (SELECT doc_id, pos, x, e, lead(e) OVER (PARTITION BY doc_id ORDER BY pos) AS f, count(*) OVER (PARTITION BY doc_id) AS n FROM ev),
raw AS (SELECT doc_id, pos, n, list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f)) + 1e-8) AS s FROM sim WHERE f IS NOT NULL),
smooth AS (SELECT doc_id, pos, CASE WHEN n - 1 > 3 THEN avg(s) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE s END AS s FROM raw)"""


@q(f"WITH {_SEM} SELECT doc_id, pos, round(s, 6) AS s FROM raw")
def w2_adjacent_similarity(spark, sf):
    return chunking.adjacent(_sentences(spark, sf)).where("similarity is not null").select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("similarity", 6).alias("s"))


def _smoothed(spark, sf):
    rows = chunking.adjacent(_sentences(spark, sf)).where("similarity is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "similarity"))).alias("i"))
    return rows.select("doc_id", F.transform("i", lambda x: x["similarity"]).alias("raw")).select("doc_id", chunking.smooth(F.col("raw")).alias("v"))


@q(f"WITH {_SEM} SELECT doc_id, pos, round(s, 6) AS s FROM smooth")
def w3_smoothed(spark, sf):
    return _smoothed(spark, sf).select("doc_id", F.posexplode("v").alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("s", 6).alias("s"))


@q(f"WITH {_SEM} SELECT doc_id, round(quantile_cont(s, 0.25), 6) AS limit_25 FROM smooth GROUP BY 1")
def w5_percentile(spark, sf):
    return _smoothed(spark, sf).select("doc_id", F.round(chunking.percentile_of(F.col("v"), 25.0), 6).alias("limit_25"))


# Breaks in SQL: a fold by a recursive query, one sentence a step.
_FOLD = f"""{_SEM}, seq AS (SELECT doc_id, pos, x, length(x) AS n, s FROM ev LEFT JOIN smooth USING (doc_id, pos)),
per AS (SELECT doc_id, list(x ORDER BY pos) AS xs, list(n ORDER BY pos) AS ns, list(s ORDER BY pos) AS ss, {{limit}} AS lim FROM seq GROUP BY 1),
fold AS (SELECT doc_id, 0 AS i, 0::BIGINT AS len, [0] AS cuts FROM per
  UNION ALL SELECT doc_id, i + 1, CASE WHEN stop THEN 0 ELSE m END, CASE WHEN stop THEN list_append(cuts, i + 1) ELSE cuts END
  FROM (SELECT f.doc_id, f.i, f.cuts, f.len + ns[f.i + 1] + 1 AS m, (round(ss[f.i + 1], 12) < round(lim, 12) OR f.len + ns[f.i + 1] + 1 > 1000) AND f.len + ns[f.i + 1] + 1 >= 100 AS stop FROM fold f JOIN per USING (doc_id) WHERE f.i < len(xs) - 1)),
cut AS (SELECT doc_id, xs, CASE WHEN len(xs) <= 2 THEN [0] ELSE cuts END AS cuts FROM fold JOIN per USING (doc_id) WHERE i = len(xs) - 1),
part AS (SELECT doc_id, xs, unnest(cuts) AS a, unnest(list_append(cuts[2:], len(xs))) AS b, generate_subscripts(cuts, 1) - 1 AS position FROM cut)
SELECT doc_id, CAST(position AS BIGINT) AS position, md5(array_to_string(xs[a + 1 : b], ' ')) AS m FROM part"""


def _digest(chunks):
    return chunks.select("doc_id", F.col("position").cast("long").alias("position"), F.md5("content").alias("m"))


@q("WITH RECURSIVE " + _FOLD.format(limit="0.8"))
def f9_semantic_chunks(spark, sf):
    return _digest(chunking.semantic_chunks(_sentences(spark, sf), threshold=0.8))


@q("WITH RECURSIVE " + _FOLD.format(limit="quantile_cont(s, 0.25)"))
def f10_percentile_chunks(spark, sf):
    return _digest(chunking.semantic_chunks(_sentences(spark, sf), percentile=25.0))


@q("""SELECT doc_id, begin, md5(substr(text, greatest(begin - 100, 0) + 1, least(begin + 512, length(text)) + 100 - greatest(begin - 100, 0))) AS m
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 462)) AS begin FROM documents WHERE length(text) > 0)""")
def f14_late_context(spark, sf):
    out = chunking.fixed_chunks(t(spark, sf, "documents"), reach=100)
    return out.select("doc_id", F.col("begin").cast("long").alias("begin"), F.md5("context").alias("m"))


_OVERLAP = f"len(list_intersect(list_distinct({SPLIT_LOW('query')}), {SPLIT_LOW('x')})) / len(list_distinct({SPLIT_LOW('query')}))"


@q(f"""{_BM25.replace("WITH ", "WITH RECURSIVE ", 1)}, sen AS (SELECT query_id, b.text AS query, doc_id AS chunk_id, rk, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT query_id, doc_id, rk, list_filter({SENTENCES('text')}, lambda y: length(y) > 20) AS l FROM bm25 JOIN documents USING (doc_id) WHERE rk <= 3) JOIN benchmark b ON item_id = query_id),
sc2 AS (SELECT query_id, chunk_id, rk, pos, x, length(x) // 4 AS tokens, {_OVERLAP} AS o FROM sen),
item AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, rk, pos, chunk_id) AS n, floor(sum(tokens) OVER (PARTITION BY query_id) * 0.5) AS budget FROM sc2),
fold AS (SELECT query_id, 0 AS n, 0 AS used, 0 AS taken, false AS stop, false AS took FROM item WHERE n = 1
  UNION ALL SELECT query_id, n, CASE WHEN take THEN used + tokens ELSE used END, CASE WHEN take THEN taken + 1 ELSE taken END, stop OR (take AND used + tokens >= budget AND taken + 1 >= 1), take
  FROM (SELECT i.query_id, i.n, f.used, f.taken, f.stop, i.tokens, i.budget, NOT f.stop AND (f.used + i.tokens <= i.budget OR f.taken < 1) AS take FROM fold f JOIN item i ON i.query_id = f.query_id AND i.n = f.n + 1))
SELECT query_id, chunk_id, min(rk) AS rank, md5(string_agg(x, ' ' ORDER BY pos)) AS m, sum(tokens)::BIGINT AS tokens FROM fold JOIN item USING (query_id, n) WHERE took GROUP BY 1, 2""")
def q15_compress(spark, sf):
    """Greedy sentence budget for the hits of every benchmark item."""
    from .base import index, questions

    docs, ask = t(spark, sf, "documents"), questions(spark, sf)
    hits = index(spark, sf).search(ask, 3).join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").withColumnRenamed("doc_id", "chunk_id")
    return rerank.compress(hits, ask).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.md5("content").alias("m"), "tokens")


@q("SELECT CASE lang WHEN 'en' THEN 'en.txt' WHEN 'de' THEN source || '.md' ELSE source END AS file, count(*) AS chunks FROM documents GROUP BY 1")
def a36_inventory(spark, sf):
    """By file name, by stored name without its hash, by the last part of the source."""
    name = F.when(F.col("lang") == "en", "en.txt")
    stored = F.when(F.col("lang") == "de", F.concat("source", F.lit(".md_"), F.substring(F.md5("text"), 1, 8)))
    return metrics.inventory(t(spark, sf, "documents"), name, stored, F.concat(F.lit("bucket/"), "source"))


@q(f"WITH RECURSIVE {_PACKS} SELECT doc_id, sum(length(content) // 4)::BIGINT AS tokens FROM chunks GROUP BY 1")
def a37_token_totals(spark, sf):
    return _chunks(spark, sf).groupBy("doc_id").agg(F.sum(tx.quarter_tokens(F.col("content"))).alias("tokens"))
