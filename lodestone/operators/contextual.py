"""Contextual headers for chunks: prompts for batches of chunks, answers read back, and a cache of headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header_key(source: Column, content: Column) -> Column:
    """The cache key of a chunk's header: its source and the beginning of its text."""
    return F.md5(F.concat(source, F.lit(":"), F.substring(content, 1, 200)))


def prompts(chunks: DataFrame, size: int = 20) -> DataFrame:
    """(doc_id, batch, chunks, prompt): up to `size` consecutive chunks (doc_id, position, content) a prompt, numbered from 0."""
    rows = chunks.withColumn("batch", F.floor(F.col("position") / size).cast("int"))
    item = F.struct("position", F.concat(F.lit("CHUNK_"), (F.col("position") % size).cast("string"), F.lit(":\n"), "content").alias("t"))
    out = rows.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("i"))
    lead = "Say in one sentence for each chunk what it is about in its document. Answer in lines `CHUNK_n: sentence`.\n\n"
    return out.select("doc_id", "batch", F.size("i").alias("chunks"), F.concat(F.lit(lead), F.array_join(F.transform("i", lambda x: x["t"]), "\n\n")).alias("prompt"))


def headers(answers: DataFrame, chunks: DataFrame, size: int = 20, fallback: str = "Part of the document.") -> DataFrame:
    """(doc_id, position, header) of answers (doc_id, batch, response); a chunk without a line gets the fallback."""
    rows = chunks.select("doc_id", "position", F.floor(F.col("position") / size).cast("int").alias("batch")).join(answers, ["doc_id", "batch"], "left")
    line = F.call_function("regexp_extract", F.col("response"), F.concat(F.lit(r"(?m)^\s*CHUNK_"), (F.col("position") % size).cast("string"), F.lit(r":[ \t]*(.*)$")), F.lit(1))
    found = F.nullif(F.trim(F.coalesce(line, F.lit(""))), F.lit(""))
    return rows.select("doc_id", "position", F.coalesce(found, F.lit(fallback)).alias("header"))


def cached_headers(chunks: DataFrame, cache: DataFrame, make) -> tuple[DataFrame, DataFrame]:
    """Headers of chunks (doc_id, position, source, content) from a cache (key, header), made by make(missing chunks) ->
    (doc_id, position, header) for the rest; and the rows to add to the cache."""
    keyed = chunks.withColumn("key", header_key(F.col("source"), F.col("content")))
    hit = keyed.join(cache.select("key", "header"), "key").select("doc_id", "position", "header")
    miss = keyed.join(cache.select("key"), "key", "left_anti")
    made = make(miss)
    fresh = miss.join(made, ["doc_id", "position"]).groupBy("key").agg(F.min_by("header", F.struct("doc_id", "position")).alias("header"))
    return hit.unionByName(made.select("doc_id", "position", "header")), fresh
