"""Model providers behind one interface; the defaults are deterministic and offline."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, cluster, retrieval
from ..operators import rerank as reranking
from .retry import gathered, retried


class Generator(Protocol):
    def generate(self, prompts: DataFrame) -> DataFrame:
        """(query_id, query, context) to (query_id, response)."""


class Embedder(Protocol):
    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, embedding)."""


class ExtractiveGenerator:
    """Answers with the sentence of the context that shares most words with the query, citing its source."""

    def generate(self, prompts: DataFrame) -> DataFrame:
        rows = prompts.select("query_id", "query", F.posexplode(F.split("context", r"\n\n---\n\n")).alias("n", "block"))
        rows = rows.select("query_id", "query", "n", F.posexplode(tx.sentences(F.regexp_replace("block", r"^\[Source \d+\]\n", ""))).alias("p", "s"))
        best = F.min_by(F.concat("s", F.lit(" ["), (F.col("n") + 1).cast("string"), F.lit("]")), F.struct(-tx.overlap(F.col("query"), F.col("s")), "n", "p"))
        return rows.groupBy("query_id").agg(best.alias("response"))


class RecordedGenerator:
    """Replays a table (query_id, response)."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def generate(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("query_id").join(self.responses, "query_id").select("query_id", "response")


class CallGenerator:
    """Calls a client once per prompt inside Arrow batches, `at_once` at a time, with jittered retries; the client is
    built once per worker batch stream. A call that fails for good gives a null response and its error."""

    def __init__(self, client: Callable[[], Callable[[str], str]], retries: int = 3, base: float = 1.0, at_once: int = 4):
        self.client, self.retries, self.base, self.at_once = client, retries, base, at_once

    def generate(self, prompts: DataFrame) -> DataFrame:
        make, retries, base, at_once = self.client, self.retries, self.base, self.at_once

        def run(frames):
            call = make()
            for frame in frames:
                asked = [f"{c}\n\n{q}" for q, c in zip(frame["query"], frame["context"], strict=True)]
                out = gathered(retried(call, retries, base), asked, at_once)
                failed = [isinstance(x, Exception) for x in out]
                yield frame[["query_id"]].assign(response=[None if f else x for x, f in zip(out, failed, strict=True)], error=[str(x) if f else None for x, f in zip(out, failed, strict=True)])

        kind = dict(prompts.dtypes)["query_id"]
        return prompts.select("query_id", "query", "context").mapInPandas(run, f"query_id {kind}, response string, error string")


class HashEmbedder:
    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        return cluster.hash_embed(rows, key, text, self.dims)

    def embed_in_place(self, rows: DataFrame, text: str) -> DataFrame:
        """The rows with their embedding, so that they needn't be joined again."""
        return cluster.hash_embed(rows, text, text, self.dims, tuple(rows.columns))


class Chunker(Protocol):
    def __call__(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text) to (doc_id, position, content, chunk_id)."""


class Retriever(Protocol):
    def __call__(self, queries: DataFrame, top_k: int) -> DataFrame:
        """(query_id, query) to (query_id, doc_id, score, rank)."""


class Reranker(Protocol):
    def __call__(self, hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, rank, content) to (query_id, chunk_id, score, rank)."""


class TokenEncoder(Protocol):
    def __call__(self, text: str):
        """Begins, ends and vectors of a text's tokens."""


class Evaluator(Protocol):
    def __call__(self, rows: DataFrame) -> DataFrame:
        """Claims, contexts or answers of queries to (query_id, score)."""


class Extractor(Protocol):
    def __call__(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text) to (doc_id, name, type, ...)."""


def by_overlap(hits: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rerank by the share of the query's words that a content has; ties keep the better rank."""
    rows = hits.join(queries.select("query_id", "query"), "query_id").withColumn("score", tx.overlap(F.col("query"), F.col("content")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def middle_last(rerank: Reranker) -> Reranker:
    """A reranker whose result is then put into the order that leaves the middle to the weakest (column position)."""
    return lambda hits, queries, k=10: reranking.lost_in_middle(rerank(hits, queries, k))


def bm25_search(docs: DataFrame) -> Retriever:
    return lambda queries, top_k=10: retrieval.bm25(docs, queries, top_k)


REGISTRY: dict[str, dict[str, Callable]] = {
    "generator": {"extractive": ExtractiveGenerator, "recorded": RecordedGenerator, "call": CallGenerator},
    "embedder": {"hash": HashEmbedder},
    "chunker": {"fixed": lambda **o: partial(chunking.fixed_chunks, **o), "sentence": lambda **o: partial(chunking.sentence_chunks, **o), "soft": lambda **o: partial(chunking.soft_chunks, **o), "recursive": lambda **o: partial(chunking.recursive_chunks, **o), "token": lambda **o: partial(chunking.token_chunks, **o), "markdown": lambda **o: partial(chunking.markdown_chunks, **o), "hierarchical": lambda **o: partial(chunking.hierarchical_chunks, **o)},
    "retriever": {"bm25": bm25_search, "index": lambda index: index.search},
    "reranker": {"overlap": lambda: by_overlap, "scored": lambda scorer: lambda hits, queries, k=10: reranking.scored(hits, queries, scorer, k), "middle_last": middle_last},
}


def register(kind: str, name: str) -> Callable:
    """Decorator that adds a component under a name."""

    def add(item):
        REGISTRY.setdefault(kind, {})[name] = item
        return item

    return add


def create(kind: str, name: str, *args, **kwargs):
    try:
        return REGISTRY[kind][name](*args, **kwargs)
    except KeyError as e:
        raise ValueError(f"no {kind} named {name}; there are {sorted(REGISTRY.get(kind, {}))}") from e


# Prompt templates, by name; {field} is filled from columns.
TEMPLATES = {
    "answer": "Answer the question from the {sources} sources below and cite them as [n].\n\n{context}\n\nQuestion: {query}\nAnswer:",
    "rewrite": "Rewrite this question in {n} other ways, one a line: {query}",
    "hypothetical": "Write a short passage that answers: {query}",
    "claims": "List the factual claims of this text, one a line:\n{text}",
}


def prompt(name: str, **fields: Column) -> Column:
    """A template as a column expression."""
    out: list[Column] = []
    rest = TEMPLATES[name]
    while "{" in rest:
        head, _, rest = rest.partition("{")
        field, _, rest = rest.partition("}")
        out += [F.lit(head), fields[field].cast("string")]
    return F.concat(*out, F.lit(rest))


def instruct(kind: str, text: Column) -> Column:
    """Instruction prefix of an embedding input."""
    lead = {"query": "Find documents that answer this question: ", "document": "A document that questions are held against: ", "similarity": "Compare the meaning of this text with others: ", "classification": "Say which class this text belongs to: ", "clustering": "Group this text with others on its subject: "}
    return F.concat(F.lit(lead[kind]), text)
