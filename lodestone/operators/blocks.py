"""Exact search in Arrow batches: rows meet a block of queries as matrices; a task keeps the k best rows of every query.

A block of queries comes to the driver and is broadcast; its size is bounded by `retrieval.in_blocks`. What leaves a task
are k rows a query at most, so nothing that grows with pairs is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Scores that are held at once.
CELLS = 1 << 19
#: Query terms that meet documents as a dense matrix: those that this many queries ask for, and so many terms at most.
DENSE_QUERIES, DENSE_TERMS = 8, 1024


class Best:
    """The k best rows of each of n queries by score (rounded to 9 digits, as `retrieval.top` ranks), then by key."""

    def __init__(self, n: int, k: int, least: float = -np.inf):
        self.n, self.k = n, k
        self.least = np.full(n, least)
        self.q, self.s, self.ids = np.zeros(0, int), np.zeros(0), None
        self.waiting: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def offer(self, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: rows by queries; -inf stands for a null score, NaN is above all (as in Spark)."""
        if np.isnan(scores.max(initial=0.0)):
            scores = np.where(np.isnan(scores), np.inf, scores)
        if len(scores) > self.k and len(self.q) < self.n * self.k:
            cut = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            self.least = np.maximum(self.least, np.where(np.isfinite(cut), cut - 2e-9 * np.maximum(1, np.abs(cut) * 1e-5), cut))
        i, q = np.nonzero(scores >= self.least)
        if not len(i):
            return
        self.waiting.append((q, scores[i, q], ids.take(pa.array(i))))
        if sum(len(x[0]) for x in self.waiting) >= max(4096, self.n * self.k // 2):
            self._cut()

    def _cut(self) -> None:
        """Take in what waits and keep the best."""
        if not self.waiting:
            return
        self.q, self.s = (np.concatenate([x, *(w[i] for w in self.waiting)]) for i, x in enumerate((self.q, self.s)))
        self.ids = pa.concat_arrays([*([] if self.ids is None else [self.ids]), *(w[2] for w in self.waiting)])
        self.waiting = []
        with np.errstate(invalid="ignore"):
            rounded = np.copysign(np.floor(np.abs(self.s) * 1e9 + 0.5), self.s) / 1e9
        rounded = np.where(np.isfinite(rounded), rounded, self.s)
        known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        if pa.types.is_integer(self.ids.type):
            value = pc.fill_null(self.ids, 0).to_numpy(zero_copy_only=False)
        else:
            value = _places(self.ids.to_pylist())
        order = np.lexsort((value, known, -rounded, self.q))
        q = self.q[order]
        first = np.searchsorted(q, q)
        order = order[np.arange(len(q)) - first < self.k]
        self.q, self.s, self.ids = self.q[order], self.s[order], self.ids.take(pa.array(order))
        last = np.flatnonzero(np.arange(len(self.q)) - np.searchsorted(self.q, self.q) == self.k - 1)
        at = rounded[order][last]
        self.least[self.q[last]] = np.maximum(self.least[self.q[last]], np.where(np.isfinite(at), at - 1e-9 * np.maximum(1, np.abs(at) * 1e-5), at))

    def batch(self, query_ids: pa.Array, names: list[str]) -> pa.RecordBatch | None:
        self._cut()
        if self.ids is None:
            return None
        s = np.where(np.isposinf(self.s), np.nan, self.s)
        score = pa.array(s, mask=np.isneginf(s), from_pandas=False)
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.q)), self.ids, score], names=names)


def _places(values: list) -> np.ndarray:
    """Where each value stands among the distinct ones that aren't null."""
    order = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}))}
    return np.array([order.get(v, 0) for v in values])


def plain(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def matrix(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which of them are whole: there, of `dims` numbers (the first one's if not given), none null. Others are zeros."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if dims is None:
        dims = int(size[size >= 0][0]) if (size >= 0).any() else 0
    if len(size) and (size == dims).all() and not flat.null_count:
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(size), dims), np.ones(len(size), bool)
    out, fit = np.zeros((len(size), dims)), size == dims
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    end = np.cumsum(np.maximum(size, 0))
    at = (end[fit] - dims)[:, None] + np.arange(dims)
    if flat.null_count:
        hole = flat.is_null().to_numpy(zero_copy_only=False)
        good = ~hole[at].any(1)
        fit[np.flatnonzero(fit)[~good]] = False
        at = at[good]
    out[fit] = values[at]
    return out, fit


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))
    return x / np.where(n == 0, 1.0, n)[:, None]


def search(rows: DataFrame, key: str, vector: str, query_ids: pa.Array, scorer: Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray]]], k: int, least: float = -np.inf) -> DataFrame:
    """(query_id, key, score): the k best rows of every query in each task. scorer: from a batch's column to (begin, end, scores of rows by queries)."""
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((query_ids, scorer))

    def run(batches):
        ids, score = sent.value
        best = Best(len(ids), k, least)
        for b in batches:
            names = plain(b.column(0))
            for begin, end, s in score(*(plain(c) for c in b.columns[1:])):
                best.offer(s, names.slice(begin, end - begin))
        out = best.batch(ids, ["query_id", key, "score"])
        if out is not None:
            yield from (out.slice(i, 1 << 16) for i in range(0, len(out), 1 << 16))

    from pyspark.sql.pandas.types import from_arrow_type

    kind = from_arrow_type(query_ids.type).simpleString()
    columns = [vector] if isinstance(vector, str) else vector
    return rows.select(key, *columns).mapInArrow(run, f"query_id {kind}, `{key}` {dict(rows.dtypes)[key]}, score double")


def collected(queries: DataFrame) -> dict[str, pa.Array]:
    """A block of queries as Arrow columns."""
    ship(queries.sparkSession)
    table = queries.toArrow()
    return {c: plain(table.column(c)) for c in table.column_names}


class Pairs:
    """Cosine, dot or euclidean (1 / (1 + distance)) of vectors with query vectors. Where a cosine isn't defined it is 0, another score null."""

    def __init__(self, queries: pa.Array, metric: str):
        self.metric, self.n = metric, len(queries)
        size = pc.fill_null(pc.list_value_length(queries), -1).to_numpy(zero_copy_only=False)
        self.parts = []
        for d in np.unique(size[size >= 0]).tolist():
            x, ok = matrix(queries, d)
            at = np.flatnonzero(ok)
            if len(at):
                self.parts.append((d, at, unit(x[at]) if metric == "cosine" else x[at]))

    def __call__(self, column: pa.Array):
        none = 0.0 if self.metric == "cosine" else -np.inf
        made = []
        for d, at, q in self.parts:
            x, ok = matrix(column, d)
            made.append((at, q, unit(x) if self.metric == "cosine" else x, ok))
        step = max(1, CELLS // max(1, self.n))
        for begin in range(0, len(column), step):
            end = min(begin + step, len(column))
            out = None
            for at, q, x, ok in made:
                x, ok = x[begin:end], ok[begin:end]
                s = x @ q.T
                if self.metric == "euclidean":
                    far = np.stack([np.sqrt(((x - y) ** 2).sum(1)) for y in q], axis=1)
                    s = 1 / (1 + far)
                if not ok.all():
                    s[~ok] = none
                if len(at) == self.n:
                    out = s
                else:
                    out = np.full((end - begin, self.n), none) if out is None else out
                    out[:, at] = s
            yield begin, end, np.full((end - begin, self.n), none) if out is None else out


def _steps(queries: pa.Array) -> tuple[list[tuple[np.ndarray, pa.Array]], np.ndarray]:
    """Of arrays of vectors: for each place the queries that have one there, with it; and each one's length (-1: null)."""
    size = pc.fill_null(pc.list_value_length(queries), -1).to_numpy(zero_copy_only=False)
    begin = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    flat = queries.flatten()
    out = []
    for j in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > j)
        out.append((at, flat.take(pa.array(begin[at] + j))))
    return out, size


class MaxSim:
    """Sum over query vectors of the greatest dot product with one of a row's vectors; null where a query vector has none."""

    def __init__(self, queries: pa.Array):
        steps, size = _steps(queries)
        self.n, self.null = len(queries), size < 0
        self.steps = []
        whole = pc.fill_null(pc.list_value_length(queries.flatten()), -1).to_numpy(zero_copy_only=False)
        self.dims = np.unique(whole[whole >= 0]).tolist()
        for at, vectors in steps:
            parts = []
            for d in self.dims:
                x, ok = matrix(vectors, d)
                parts.append((d, at[ok], x[ok]))
            self.steps.append((at, parts))

    def __call__(self, column: pa.Array):
        size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.maximum(size, 0))
        flat = column.flatten()
        made = {d: matrix(flat, d) for d in self.dims}
        step = max(1, CELLS // max(1, self.n * int(size.max(initial=1) or 1)))
        for begin in range(0, len(column), step):
            end = min(begin + step, len(column))
            low = int(ends[begin - 1]) if begin else 0
            owner = np.repeat(np.arange(end - begin), np.maximum(size[begin:end], 0))
            total = np.zeros((end - begin, self.n))
            total[:, self.null] = -np.inf
            blocks = {}
            for d, (x, ok) in made.items():
                x, ok = x[low : int(ends[end - 1])], ok[low : int(ends[end - 1])]
                own = owner[ok]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
                blocks[d] = (x[ok], own[first], first)
            for at, parts in self.steps:
                best = np.full((end - begin, self.n), -np.inf)
                for d, to, q in parts:
                    x, own, first = blocks[d]
                    if not len(to) or not len(first):
                        continue
                    s = x @ q.T
                    even = len(x) // len(first) if len(x) % len(first) == 0 else 0
                    if even and np.array_equal(first, np.arange(len(first)) * even):
                        m = s.reshape(len(first), even, len(to)).max(1)
                    else:
                        m = np.maximum.reduceat(s, first, axis=0)
                    if len(own) == end - begin and len(to) == self.n:
                        best = m
                    else:
                        best[np.ix_(own, to)] = m
                if len(at) == self.n:
                    total += best
                else:
                    total[:, at] += best[:, at]
            yield begin, end, total


class SoftMaxSim:
    """Mean of a query's three best cosines (of all if fewer) with a row's vector; null for a query without any."""

    def __init__(self, queries: pa.Array):
        steps, size = _steps(queries)
        self.n, self.empty = len(queries), size <= 0
        self.many = np.clip(size, 1, 3).astype(float)
        self.steps = [(at, Pairs(vectors, "cosine")) for at, vectors in steps]

    def __call__(self, column: pa.Array):
        step = max(1, CELLS // max(1, self.n))
        for begin in range(0, len(column), step):
            end = min(begin + step, len(column))
            part = column.slice(begin, end - begin)
            shape = (end - begin, self.n)
            a, b, c = np.full(shape, -np.inf), np.full(shape, -np.inf), np.full(shape, -np.inf)
            for at, pairs in self.steps:
                s = np.concatenate([x for _, _, x in pairs(part)])
                if len(at) < self.n:
                    whole = np.full(shape, -np.inf)
                    whole[:, at] = s
                    s = whole
                low = np.minimum(a, s)
                np.maximum(a, s, out=a)
                np.maximum(c, np.minimum(b, low), out=c)
                np.maximum(b, low, out=b)
            b[:, self.many < 2], c[:, self.many < 3] = 0.0, 0.0
            out = (a + b + c) / self.many
            out[:, self.empty] = -np.inf
            yield begin, end, out


#: Texts with other characters are cut into tokens by the JVM; of these, bytes of letters, digits and underscores (two-byte characters: see `cut`).
OTHER = r"[^\u0000-\u012f\u0131-\u017f]"
_WORD = np.array([chr(i).isalnum() or i == 95 if i < 128 else i != 0xC2 for i in range(256)])
_C2 = np.isin(np.arange(256), [0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE])
_C3 = ~np.isin(np.arange(256), [0x97, 0xB7])


def cut(texts: pa.Array) -> pa.ListArray:
    """`text.tokens` of texts without OTHER characters."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    at = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    word = _WORD[data]
    for lead, good in ((0xC2, _C2), (0xC3, _C3)):
        i = np.flatnonzero(data == lead)
        word[i] = word[i + 1] = good[data[i + 1]]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    start[first] = word[first]
    begin = np.flatnonzero(start)
    ends = np.r_[np.cumsum(word)[begin] - 1, word.sum()].astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data[word]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, at).astype(np.int32)), tokens)


def opened(first: pa.Array, *rest: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array | None]:
    """(tokens, lengths, counts) of a batch: of term lists (terms, dl, tfs), or of texts (x; t: their tokens if the JVM cut them; dl where it isn't their number)."""
    if not pa.types.is_string(first.type):
        return first, *rest
    t, dl = rest
    if t.null_count < len(t):
        first = pc.if_else(t.is_valid(), pa.scalar(None, first.type), first)
        tokens = pc.if_else(t.is_valid(), t.cast(pa.list_(pa.string())), cut(first).cast(pa.list_(pa.string())))
    else:
        tokens = cut(first)
    there = pc.or_(first.is_valid(), t.is_valid())
    return tokens, pc.if_else(there, pc.coalesce(dl, pc.list_value_length(tokens)), pa.scalar(None, pa.int32())), None


def counted(tokens: pa.Array, terms: pa.Array | None = None, counts: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place, tf, terms) of arrays of tokens, sorted by row and place in `terms` (by default the distinct ones); others are left out.

    counts: how often each token stands for, where the arrays hold distinct ones."""
    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    flat = tokens.flatten()
    if terms is None:
        coded = flat.dictionary_encode()
        terms, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        place = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = place >= 0
    pair = np.repeat(np.arange(len(size)), size)[known] * max(1, len(terms)) + place[known]
    if counts is None:
        pair, tf = np.unique(pair, return_counts=True)
    else:
        tf = counts.flatten().to_numpy(zero_copy_only=False)[known]
        order = np.argsort(pair)
        pair, tf = pair[order], tf[order]
    row, place = np.divmod(pair, max(1, len(terms)))
    return row, place, tf.astype(float), terms


def term_lists(rows: DataFrame) -> DataFrame:
    """(doc_id, dl, terms, tfs): the distinct tokens of rows (doc_id, x, t, dl) with their counts."""
    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            ids, *texts = (plain(c) for c in b.columns)
            t, dl, _ = opened(*texts)
            row, place, tf, terms = counted(t)
            ends = pa.array(np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, dl, pa.ListArray.from_arrays(ends, terms.take(pa.array(place))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], names=["doc_id", "dl", "terms", "tfs"])

    return rows.select("doc_id", "x", "t", "dl").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, dl int, terms array<string>, tfs array<int>")


def frequencies(rows: DataFrame, columns: list[str], terms: pa.Array) -> tuple[int, int, int, np.ndarray]:
    """Rows, rows with a length, their lengths' sum, and how many rows have each term. columns: what `opened` takes."""
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(terms)

    def run(batches):
        seen, n, some, total = np.zeros(len(sent.value), np.int64), 0, 0, 0
        for b in batches:
            t, dl, tf = opened(*(plain(c) for c in b.columns))
            seen += np.bincount(counted(t, sent.value, tf)[1], minlength=len(seen))
            n, some, total = n + len(dl), some + len(dl) - dl.null_count, total + (pc.sum(dl).as_py() or 0)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2, -3]), pa.array(np.r_[seen[at], n, some, total])], names=["place", "n"])

    found = rows.select(*columns).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = found.column("place").to_numpy(), found.column("n").to_numpy()
    head = dict(zip(place[place < 0].tolist(), n[place < 0].tolist(), strict=True))
    df = np.zeros(len(terms), np.int64)
    df[place[place >= 0]] = n[place >= 0]
    return head.get(-1, 0), head.get(-2, 0), head.get(-3, 0), df


class Asked:
    """The terms of a block of queries: (query_id, [(term, qtf)]) as Arrow columns."""

    def __init__(self, query_ids: pa.Array, items: pa.Array):
        size = pc.list_value_length(items).to_numpy(zero_copy_only=False)
        flat = items.flatten()
        self.query_ids = query_ids
        self.terms = pa.array(sorted(set(flat.field("term").to_pylist())), pa.string())
        place = pc.index_in(flat.field("term"), value_set=self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(place, kind="stable")
        self.place, self.q = place[order], np.repeat(np.arange(len(size)), size)[order]
        self.qtf = flat.field("qtf").to_numpy(zero_copy_only=False)[order].astype(float)


class Bm25:
    """Scores of documents as matrices: terms that many queries share as a dense product, the others posting by posting."""

    def __init__(self, asked: Asked, n: int, avgdl: float, df: np.ndarray, k1: float, b: float):
        self.n, self.terms, self.k1, self.b, self.avgdl = len(asked.query_ids), asked.terms, k1, b, max(avgdl, 1.0)
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
        weight = asked.qtf * idf[asked.place]
        many = np.bincount(asked.place, minlength=len(asked.terms))
        cost = many * df
        dense = np.flatnonzero(many >= DENSE_QUERIES)
        dense = np.sort(dense[np.argsort(-cost[dense], kind="stable")][:DENSE_TERMS])
        self.column = np.full(len(asked.terms), -1)
        self.column[dense] = np.arange(len(dense))
        self.w = np.zeros((len(dense), self.n))
        at = self.column[asked.place]
        self.w[at[at >= 0], asked.q[at >= 0]] = weight[at >= 0]
        self.begin, self.many, self.q, self.weight = np.cumsum(many) - many, many, asked.q, weight

    def __call__(self, *columns: pa.Array):
        tokens, dl, counts = opened(*columns)
        row, place, tf, _ = counted(tokens, self.terms, counts)
        length = pc.fill_null(dl, 0).to_numpy(zero_copy_only=False).astype(float)[row]
        x = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.avgdl))
        step = max(1, CELLS // max(1, self.n))
        for begin in range(0, len(tokens), step):
            end = min(begin + step, len(tokens))
            a, z = np.searchsorted(row, (begin, end))
            r, p, v = row[a:z] - begin, place[a:z], x[a:z]
            column = self.column[p]
            some = column >= 0
            block = np.zeros((end - begin, len(self.w)))
            block[r[some], column[some]] = v[some]
            out = block @ self.w
            r, p, v = r[~some], p[~some], v[~some]
            n = self.many[p]
            own = np.repeat(np.arange(len(p)), n)
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + self.begin[p][own]
            out += np.bincount(r[own] * self.n + self.q[at], weights=v[own] * self.weight[at], minlength=out.size).reshape(out.shape)
            yield begin, end, out


#: BM25 scores of documents with a term of the query are above it.
POSITIVE = float(np.nextafter(0, 1))
