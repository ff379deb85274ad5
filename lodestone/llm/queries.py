"""The registered queries opN_<name>, each over its whole table, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fingerprint, jaccard, linededup, quality, sharding, substrdup, tokencount, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
@query
def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.id_text(table(spark, sf_dir, "documents"))
    return bpe.encode_decode(docs, vocabulary(), with_ids=False).drop("text")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrdup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


SQL["op5_substring_dedup"] = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (
  SELECT doc_id, s, array_to_string(ws[s:s+34], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35)),
again AS (SELECT win FROM starts GROUP BY win HAVING count(*) > 1),
bad AS (SELECT doc_id, list(s ORDER BY s) AS st FROM starts SEMI JOIN again USING (win) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM (SELECT doc_id, unnest(st) AS s FROM bad)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)"""


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op6_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.m AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = w.doc_id"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL["op8_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line, translate(trim(u.line, {_WHITE}), '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS i) u),
keys AS (
  SELECT key, max(doc_id) AS owner FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.i, l.line, (k.key IS NOT NULL AND k.owner <> l.doc_id) AS gone FROM lines l LEFT JOIN keys k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.id_text(table(spark, sf_dir, "documents"))
    return tokencount.count_tokens(docs, vocabulary()).drop("text")


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))
