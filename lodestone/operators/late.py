"""Late chunking: a document's tokens are embedded in the context of the whole document, then pooled over each chunk's span."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (text) -> (begin, end, vectors): character spans of its tokens and one vector each.
TokenEmbedder = Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray]]

_TOKEN = re.compile(r"\w+")


def hash_tokens(dims: int = 8, reach: int = 2) -> TokenEmbedder:
    """A deterministic offline token embedder: digits of a token's md5, averaged with those of up to `reach` neighbours."""

    def embed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(m.start(), m.end(), m.group().lower()) for m in _TOKEN.finditer(text)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims))
        own = np.array([[b / 255 - 0.5 for b in hashlib.md5(w.encode()).digest()[:dims]] for _, _, w in found])
        total = np.vstack((np.zeros((1, dims)), np.cumsum(own, 0)))
        i = np.arange(len(own))
        low, high = np.maximum(i - reach, 0), np.minimum(i + reach + 1, len(own))
        return np.array([a for a, _, _ in found]), np.array([b for _, b, _ in found]), (total[high] - total[low]) / (high - low)[:, None]

    return embed


def late_chunks(docs: DataFrame, spans: DataFrame, embedder: Callable[[], TokenEmbedder] = hash_tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, embedding, tokens) for spans (doc_id, position, begin, end, in characters): the mean vector of the
    tokens that lie in the span, null if none does.

    A document's spans are gathered beside its text, so each text is embedded once; the embedder is built once per
    Arrow stream.
    """
    per = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "begin", "end"))).alias("spans"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(per, "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = embedder()
        for frame in frames:
            out = []
            for doc, text, places in zip(frame["doc_id"], frame["text"], frame["spans"], strict=True):
                begin, end, vectors = embed(text or "")
                total = np.vstack((np.zeros((1, vectors.shape[1])), np.cumsum(vectors, 0)))
                for p in places:
                    a, b = int(np.searchsorted(begin, p["begin"])), int(np.searchsorted(end, p["end"], "right"))
                    out.append((doc, p["position"], ((total[b] - total[a]) / (b - a)).tolist() if b > a else None, max(b - a, 0)))
            yield pd.DataFrame(out, columns=["doc_id", "position", "embedding", "tokens"])

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"doc_id {kinds['doc_id']}, position int, embedding array<double>, tokens long")
