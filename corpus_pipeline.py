"""The corpus pipeline: five stages from raw documents to token ids, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, jaccard, linededup, toxicity
from lodestone.llm.queries import table, vocabulary
from lodestone.session import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, trained on labelled ones of docs, don't reject."""
    models, weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, models, weights).where("predicted = 0").drop("score", "predicted")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more hold, but for the last holder; documents left empty stay."""
    out = linededup.drop_repeated_lines(docs)
    return out.select(*(F.col("kept_text").alias(c) if c == "text" else F.length("kept_text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def numbered(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """docs, written with a number of its own for every row (column __row)."""
    return Workspace(spark, name).table("numbered", docs.withColumn("__row", F.monotonically_increasing_id()))


def by_row(rows: DataFrame) -> DataFrame:
    """(doc_id, text) with the row's number as its id, for operators that report ids."""
    return rows.select(F.col("__row").alias("doc_id"), "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id (a null id comes last, then the row's number decides)."""
    rows = numbered(spark, docs, "near")
    groups = jaccard.near_duplicates(by_row(rows)).select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    # A row alone in its group needs no comparison.
    moved = groups.where("__row <> __group")
    member = moved.unionByName(moved.select(F.col("__group").alias("__row"), "__group").distinct())
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    member = Workspace(spark, "near").table("members", member.join(rows.select("__row", "doc_id"), "__row").select("__row", "__group", rank.alias("__rank")))
    kept = member.groupBy("__group").agg(F.min("__rank").getField("__row").alias("__row"))
    gone = member.select("__row").join(kept.select("__row"), "__row", "left_anti")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whatever their ids."""
    rows = numbered(spark, docs, "leaks")
    held = decontam.find_leaks(by_row(rows), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__row")).distinct()
    held = Workspace(spark, "leaks").table("held", held)
    return rows.join(held, "__row", "left_anti").select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the checksums of the ids and of what they decode to."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode_decode(rows, vocabulary()).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", to_tokens),
]

#: SQL can't express the trained and the tokenizing stages; tests compare the pipeline with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is a table in the shared folder."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.table(f"{i}-{name}", stage(spark, docs, sf_dir))
        if i:
            work.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
