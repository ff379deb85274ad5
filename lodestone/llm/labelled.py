"""Labelled documents, all or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


#: Labelled ids are broadcast to the documents up to this many (16 bytes each); beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def known_ids(labels: DataFrame, label: str, allowed: Column, id_col: str = "doc_id") -> DataFrame:
    """__id, y (0 or 1) of the allowed labelled ids. An id with several labels takes the largest; null labels and ids are left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).where(allowed)
    return known.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def every(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs with an allowed label: columns doc_id, y, text. Rows that repeat an id are documents of their own."""
    known = known_ids(labels, label, allowed, id_col)
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    return _texts(docs, id_col, text_col).join(known, "__id").withColumnRenamed("__id", "doc_id")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, allowed: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `most` labelled ids of either class with their texts: columns doc_id, y (0 or 1), text.

    Among the allowed ids those with the least hash are taken, so the sample doesn't hang on row order. The ids
    (2 * most at most) are broadcast. An id that several rows have gives its least text only, so the bound holds for
    repeated ids too.
    """
    known = known_ids(labels, label, allowed, id_col)
    order = [F.xxhash64("__id"), F.col("__id")]
    taken = F.broadcast(known.where("y = 0").orderBy(*order).limit(most).unionByName(known.where("y = 1").orderBy(*order).limit(most)))
    return _texts(docs, id_col, text_col).join(taken, "__id").groupBy(F.col("__id").alias("doc_id"), "y").agg(F.min("text").alias("text"))
