"""Registry of the engine's queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import lexical_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def q(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str) -> lexical_index.LexicalIndex:
    """The stored BM25 index of documents."""
    return lexical_index.for_table(spark, f"{sf_dir}/documents.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries."""
    return t(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "text as query")


# DuckDB's side of the tokenizers.
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')".format
SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: length(s) > 0)".format
WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')".format
SPLIT_LOW = lambda c: WORDS(f"lower({c})")
