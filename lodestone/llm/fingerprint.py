"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes of a text; chunk ends are the places where its top bits vanish. Chunking is
normalised: up to the wanted mean length an end must clear a strict mask, beyond it a lax one, so lengths gather
around the mean. An insertion moves only the chunks that it touches. The fingerprint is the set of distinct chunk
digests, each with the bytes it covers; containment is the share of one fingerprint's weight found in another.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import buffers, lean, pieces, stream

#: Window of the gear hash and least, mean and greatest chunk length, in bytes; strict and lax mask, in bits.
SPAN, LEAST, MEAN, MOST, STRICT, LAX = 16, 16, 32, 128, 7, 3
_GEAR = (stream(3, 256) >> np.uint64(32)).astype(np.uint32)
_WEIGHT_BITS = 24


def _gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the last SPAN bytes, built by doubling the window."""
    h = _GEAR[data]
    width = 1
    while width < SPAN:
        wide = h.copy()
        wide[width:] += h[:-width] << np.uint32(width)
        h, width = wide, width * 2
    return h


def _next(flags: np.ndarray) -> np.ndarray:
    """For each position, the first position from there on where flags holds (the length if none)."""
    n = len(flags)
    where = np.where(flags, np.arange(n, dtype=np.int64), n)
    return np.append(np.minimum.accumulate(where[::-1])[::-1], n)


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts, in order; no chunk spans two texts."""
    h = _gear(data)
    strict, lax = _next(h >> np.uint32(32 - STRICT) == 0), _next(h >> np.uint32(32 - LAX) == 0)
    n = len(data)
    at, stop = offsets[:-1].copy(), offsets[1:]
    live = at < stop
    at, stop = at[live], stop[live]
    begins, ends = [], []
    while len(at):
        mid = strict[np.minimum(at + LEAST - 1, n)] + 1
        far = lax[np.minimum(at + MEAN - 1, n)] + 1
        cut = np.minimum(np.where(mid < at + MEAN, mid, far), np.minimum(at + MOST, stop))
        begins.append(at)
        ends.append(cut)
        live = cut < stop
        at, stop = cut[live], stop[live]
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Per text the sorted digests, each packed as 40 bits of digest and 24 bits of covered bytes; a digest that covers
    more stands several times."""
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    begin, end = chunk_ends(data, offsets)
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    codes = np.fromiter((digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(begin)) >> np.uint64(_WEIGHT_BITS)
    sizes = end - begin
    cuts = np.searchsorted(begin, offsets)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, back = np.unique(codes[a:b], return_inverse=True)
        out.append(_packed(own, np.bincount(back, sizes[a:b], len(own)).astype(np.int64)))
    return out


_FULL = (1 << _WEIGHT_BITS) - 1


def _packed(own: np.ndarray, weight: np.ndarray) -> np.ndarray:
    times = -(-weight // _FULL)
    first = np.cumsum(times) - times
    shares = np.full(int(times.sum()), _FULL, np.int64)
    shares[first + times - 1] = weight - (times - 1) * _FULL
    return np.sort(np.repeat(own, times) << np.uint64(_WEIGHT_BITS) | shares.astype(np.uint64))


def _weights(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests and the bytes each covers."""
    digest, weight = fp >> np.uint64(_WEIGHT_BITS), (fp & np.uint64(_FULL)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], digest[1:] != digest[:-1])))
    return digest[first], np.add.reduceat(weight, first)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's weight that b also holds; 1 for two empty fingerprints, 0 if only a is empty."""
    if not len(a):
        return float(not len(b))
    if not len(b):
        return 0.0
    (da, wa), (db, wb) = _weights(a), _weights(b)
    at = np.minimum(np.searchsorted(db, da), len(db) - 1)
    same = db[at] == da
    return float(np.minimum(wa[same], wb[at[same]]).sum() / wa.sum())


def encode(fp: np.ndarray) -> str:
    return base64.b64encode(fp.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """The given columns and `fingerprint` string (an input column of that name is replaced). Null text: empty."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("fingerprint")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                values = [x or "" for x in part.column(text).to_pylist()]
                marks = pa.array([encode(f) for f in fingerprints(values)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, marks], names=[*part.schema.names, "fingerprint"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())]))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_successor(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows (bucket, borrowed, key, doc_id, text): ordered runs of ids, each run ending with a copy of its successor.

    Run limits are ids of the table (approximate quantiles, one scan of the id column), so the row that opens a run
    is known while mapping and can be sent to the run before it as well: one shuffle orders the whole table and no
    task needs a look at another's rows. The first row of all goes to the last run. Null ids sort first.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(low)))
    runs = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    grid = [i / runs for i in range(1, runs)] or [0.5]
    found = rows.agg(F.min("key").alias("m"), F.percentile_approx("key", F.lit(grid), F.lit(10_000)).alias("q")).first()
    limits = np.unique(np.array([found["m"], *(found["q"] or [])] if found["m"] is not None else [low], dtype=np.int64))
    shared = spark.sparkContext.broadcast(limits)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(key: pd.Series) -> pd.Series:
        edge = shared.value
        k = key.to_numpy(np.int64)
        run = np.maximum(np.searchsorted(edge, k, "right") - 1, 0)
        opens = edge[run] == k
        return pd.Series([[r, (r - 1) % len(edge)] if o else [r] for r, o in zip(run.tolist(), opens.tolist(), strict=True)])

    rows = rows.withColumn("places", places("key")).select("doc_id", "text", "key", F.posexplode("places").alias("borrowed", "bucket"))
    return rows, len(limits)


def _follow(batches: Iterator[pa.RecordBatch], block_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (bucket, borrowed, key, text): emits each own row with what its successor says of it."""
    held: list[tuple] = []
    size = 0
    last_fp: list[np.ndarray] = []

    def flush(final: bool) -> pa.RecordBatch | None:
        nonlocal held, size, last_fp
        texts = [x[3] for x in held]
        marks = last_fp + fingerprints(texts[len(last_fp) :])
        done, edited = [], []
        for i in range(len(held) - 1):
            bucket, borrowed, doc_id, text = held[i]
            if borrowed or held[i + 1][0] != bucket:
                continue
            n = len(text)
            half = n // 2
            done.append(i)
            edited.append(text[: n - half] + held[i + 1][3][:half])
        after = fingerprints(edited)
        cols = [[] for _ in range(7)]
        for i, text, fp in zip(done, edited, after, strict=True):
            own = marks[i]
            for c, v in zip(cols, (held[i][2], len(held[i][3]), hashlib.sha256(text.encode()).hexdigest(), encode(own), encode(fp), containment(own, fp), containment(own, marks[i + 1])), strict=True):
                c.append(v)
        held, last_fp = ([], []) if final else (held[-1:], marks[-1:])
        size = 0
        names = [x.split()[0] for x in _OUT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names) if done else None

    for batch in batches:
        for bucket, borrowed, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "borrowed", "doc_id", "text")), strict=True):
            if borrowed and held and held[-1][1] and held[-1][0] == bucket:
                continue  # of several rows with the successor's id the first by text counts
            held.append((bucket, borrowed, doc_id, text))
            size += len(text)
            if size >= block_bytes:
                if (out := flush(False)) is not None:
                    yield out
    if held and (out := flush(True)) is not None:
        yield out


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the same text with its second half taken from the next document.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    (containment of the document's fingerprint in the edited text's and in the next document's, 0 to 1).

    Null text counts as empty; null ids sort first; rows with equal ids are ordered by text, each is a document of
    its own; very long texts are taken whole; other columns are ignored whatever their names. An empty table gives no
    rows. A single document follows itself. Rows of one id (all null ids are one) are in one run.
    """
    ship(docs.sparkSession)
    rows, _ = with_successor(docs, id_col, text_col)
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "borrowed", "key", "text")
    return ordered.select("bucket", "borrowed", "doc_id", "text").mapInArrow(partial(_follow), _OUT)
