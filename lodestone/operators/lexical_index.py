"""A stored BM25 index: each document's terms and corpus statistics as tables, so a corpus is tokenised once; postings by term where a lookup needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import Workspace
from . import blocks, retrieval

#: Folders of postings by hash of the term: a lookup reads those of its own terms.
BUCKETS = 32


def source_version(spark: SparkSession, path: str) -> str:
    """What tells one state of a file or folder from another: names, sizes and times of its files."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(p))
    return "|".join(found)


class LexicalIndex:
    """Built at the first search and again once the version of what it was built from has changed."""

    def __init__(self, spark: SparkSession, name: str = "bm25", buckets: int = BUCKETS):
        self.spark, self.buckets, self.name = spark, buckets, name
        self.work: Workspace | None = None
        self.version: str | None = None
        self._by_term: tuple[DataFrame, DataFrame] | None = None

    def _bucket(self, term: str):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def build(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", version: str = "") -> LexicalIndex:
        """Tokenise and store; an index of another version is replaced once the new one is whole."""
        work = Workspace(self.spark, self.name)
        rows, repeated = retrieval.merged(docs, id_col, text_col)
        self._lists = work.table("lists", blocks.term_lists(rows))
        lengths = docs.select(F.size(tx.tokens(F.col(text_col))).alias("dl")) if repeated else self._lists
        self._stats = work.table("stats", lengths.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl")))
        old, self.work, self.version, self._by_term = self.work, work, version, None
        if old is not None:
            old.drop("lists", "stats", "postings", "df")
        return self

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        """Postings and document frequencies by bucket of the term, made of the lists when first asked for."""
        if self._by_term is None:
            pairs = self._lists.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc_id", F.col("x.terms").alias("term"), F.col("x.tfs").cast("long").alias("tf"), "dl")
            pairs = pairs.withColumn("bucket", self._bucket("term")).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("bucket", "term")
            postings = self.work.table("postings", pairs, "bucket")
            df = self.work.table("df", postings.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).repartition("bucket"), "bucket")
            self._by_term = postings, df
        return self._by_term

    def postings(self) -> DataFrame:
        return self._tables()[0].drop("bucket")

    def frequencies(self) -> DataFrame:
        return self._tables()[1].drop("bucket")

    def search(self, queries: DataFrame, top_k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, doc_id, score, rank) as retrieval.bm25 gives, from the stored lists."""
        return retrieval.ranked(self._lists, ["terms", "dl", "tfs"], queries, top_k, k1, b, self._stats)

    def containing(self, docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(query_id, doc_id): documents whose text holds the query's text word for word.

        The rarest token that stands inside a query (neither first nor last, so its ends are whole) leads to the
        documents to look at; queries of fewer than three tokens are held against all, in blocks.
        """
        t = F.col("t")
        rows = queries.select("query_id", "query", tx.tokens(F.col("query")).alias("t"))
        inner = rows.where(F.size("t") >= 3).select("query_id", "query", F.explode(F.array_distinct(F.slice(t, 2, F.size(t) - 2))).alias("term")).withColumn("bucket", self._bucket("term"))
        postings, df = self._tables()
        known = inner.join(df, ["bucket", "term"]).groupBy("query_id").agg(F.min_by(F.struct("bucket", "term"), F.struct("df", "term")).alias("x"), F.first("query").alias("query"), F.count(F.lit(1)).alias("known"))
        whole = inner.groupBy("query_id").agg(F.count(F.lit(1)).alias("all"))
        chosen = known.join(whole, "query_id").where("known = all").select("query_id", "query", "x.bucket", "x.term")
        found = postings.join(chosen, ["bucket", "term"]).select("query_id", "query", F.col("doc_id").alias("__d"))
        text = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("__t"))
        out = text.join(found, "__d").where("contains(__t, query)").select("query_id", F.col("__d").alias("doc_id"))
        short = rows.where(F.size("t") < 3).select("query_id", "query")
        if short.isEmpty():
            return out
        meet = lambda part: text.join(F.broadcast(part), F.expr("contains(__t, query)")).select("query_id", F.col("__d").alias("doc_id"))
        return out.unionByName(retrieval.in_blocks(short, "query_id", meet))


_KEPT: dict[tuple[str, str], LexicalIndex] = {}


def for_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """The index of a Parquet table, built by the first search of this application and again when its files change."""
    key, version = (spark.sparkContext.applicationId, path), source_version(spark, path)
    index = _KEPT.setdefault(key, LexicalIndex(spark))
    if index.version != version:
        index.build(spark.read.parquet(path), id_col, text_col, version)
    return index
