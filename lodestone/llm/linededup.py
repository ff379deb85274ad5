"""Line dedup through a sharded minimal perfect hash.

Distinct line hashes that two documents or more hold are cut into shards. Each shard gets a minimal
perfect hash (levels of bit arrays: a key belongs to the first level where no other remaining key falls on its bit,
its index is that bit's rank) and three arrays by index: fingerprint, document count (one byte, saturating) and last owner. Documents probe
the arrays with the hashes of their own lines; a line that isn't in the key set lands anywhere and its fingerprint
differs. Shards are broadcast in rounds of a bounded size, so lines are never joined with documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Workspace, ship
from .common import lean, mix, pieces

WHITE = " \t\n\v\f\r"
_LOW = -(1 << 63)
_M = (1 << 64) - 1


def line_keys(text: str, least: int) -> tuple[list[str], list[int], list[int], list[int]]:
    """A text's lines; index, hash and fingerprint of those whose key has at least `least` code points."""
    lines = text.split("\n")
    at, a, b = [], [], []
    for i, line in enumerate(lines):
        key = line.strip(WHITE)
        if len(key) >= least:
            h = xxhash.xxh3_128_intdigest(key.encode().lower())  # bytes.lower() changes A-Z only
            at.append(i)
            a.append(h & _M)
            b.append(h >> 64)
    return lines, at, a, b


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        self.bits = [np.unpackbits(x).astype(bool) for x in levels]
        self.rank, total = [], 0
        for bits in self.bits:
            self.rank.append(np.cumsum(bits) - 1 + total)
            total += int(bits.sum())

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & _M)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) < len(keys):
            raise ValueError("keys must be distinct")
        levels, rest = [], keys
        while len(rest):
            size = max(64, 2 * len(rest) + 7 & ~7)
            at = cls._place(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            rest = rest[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; some index or -1 for what isn't a key."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.bits, self.rank, strict=True)):
            at = self._place(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


_SHARD = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("levels", T.ArrayType(T.BinaryType())), *(T.StructField(n, T.BinaryType()) for n in ("prints", "counts", "owners", "rest")), T.StructField("bytes", T.LongType())])
#: Counts saturate here: thresholds lie below.
MOST_COUNT = 255


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's hash and arrays. Lines whose first 64 bits are equal can't all have a place: they are kept in a list
    (a, b, count, owner) that is searched."""
    held = rows[["a", "b", "docs", "owner"]].to_numpy(np.int64)
    held[:, 2] = np.minimum(held[:, 2], MOST_COUNT)
    _, which, many = np.unique(held[:, 0], return_inverse=True, return_counts=True)
    alone, rest = held[many[which] == 1], held[many[which] > 1]
    keys = alone[:, 0].copy().view(np.uint64)
    made = PerfectHash.build(keys)
    at = made.index(keys)
    arrays = []
    for column, kind in ((1, np.int64), (2, np.uint8), (3, np.int64)):
        x = np.zeros(len(keys), kind)
        x[at] = alone[:, column]
        arrays.append(x.tobytes())
    levels = [x.tobytes() for x in made.levels]
    arrays.append(rest.tobytes())
    size = sum(map(len, levels)) + sum(map(len, arrays))
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "levels": [levels], "prints": [arrays[0]], "counts": [arrays[1]], "owners": [arrays[2]], "rest": [arrays[3]], "bytes": [size]})


def line_stats(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """Per key (a, b: its 128-bit hash) the number of documents that hold it and the largest id among them."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("d"), F.col(text_col).cast("string").alias("t"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                hashes: dict[tuple[int, int], list[int]] = {}  # pre-aggregated: documents and largest id
                for d, text in zip(part.column("d").to_pylist(), part.column("t").to_pylist(), strict=True):
                    _, _, a, b = line_keys(text or "", least_chars)
                    for k in set(zip(a, b, strict=True)):
                        got = hashes.get(k)
                        if got is None:
                            hashes[k] = [1, d]
                        else:
                            got[0] += 1
                            got[1] = max(got[1], d)
                cols = [np.array([k[i] for k in hashes], np.uint64).view(np.int64) for i in (0, 1)]
                cols += [np.array([v[i] for v in hashes.values()], np.int64) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "docs", "owner"])

    made = rows.mapInArrow(run, "a long, b long, docs long, owner long")
    return made.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 3, least_chars: int = 20, shard_keys: int = 50_000, round_bytes: int = 96 << 20) -> DataFrame:
    """The given columns with n_lines, n_dropped (long) and kept_text (string).

    A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z in lower case. Keys of at least
    least_chars code points that at least least_docs documents hold lose all their lines, except in the document
    with the largest id among the holders (every row with that id, if ids repeat). Null and empty texts are one
    empty line. A null id is smaller than any other. Rows are documents, so repeated rows count apart. Input columns
    named as the new ones are replaced; an empty table gives an empty result.

    round_bytes bounds what one broadcast carries. More arrays than that take several rounds; each hands the numbers
    of the lines that fall (never their text) on to a last pass.
    """
    if not 0 < least_docs <= MOST_COUNT:
        raise ValueError(f"least_docs lies between 1 and {MOST_COUNT}")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    work = Workspace(spark, "lines")
    keys = work.table("keys", line_stats(docs, id_col, text_col, least_chars).where(F.col("docs") >= min(least_docs, 2)))
    shards = max(1, -(-keys.count() // shard_keys))
    shard_of: Column = F.pmod(F.shiftrightunsigned("a", 20), F.lit(shards)).cast("int")
    built = work.table("shards", keys.withColumn("shard", shard_of).groupBy("shard").applyInPandas(_build_shard, _SHARD))
    sizes = [(r["shard"], r["bytes"]) for r in built.select("shard", "bytes").orderBy("shard").toLocalIterator()]
    work.drop("keys")
    rounds: list[list[int]] = [[]]
    held = 0
    for shard, size in sizes:
        if held + size > round_bytes and rounds[-1]:
            rounds.append([])
            held = 0
        rounds[-1].append(shard)
        held += size
    out = docs
    if len(rounds) == 1:
        return _finish(out, id_col, text_col, least_chars, _fetch(built, rounds[0]), shards, least_docs, None)
    # Several rounds: mark each row, collect the fallen lines of each round beside it, then cut them in one pass.
    marked = work.table("rows", docs.withColumn("__row", F.monotonically_increasing_id()))
    found = None
    for i, members in enumerate(rounds):
        part = work.table(f"round{i}", _fallen(marked, id_col, text_col, least_chars, _fetch(built, members), shards, least_docs))
        found = part if found is None else found.unionByName(part)
    fallen = found.groupBy("__row").agg(F.flatten(F.collect_list("__fallen")).alias("__fallen"))
    return _finish(marked.join(fallen, "__row", "left").drop("__row"), id_col, text_col, least_chars, None, shards, least_docs, "__fallen")


def _fetch(built: DataFrame, members: list[int]):
    spark = built.sparkSession
    rows = built.where(F.col("shard").isin(members)).collect() if members else []  # at most round_bytes, or one shard
    return spark.sparkContext.broadcast([(r["shard"], [bytes(x) for x in r["levels"]], *(bytes(r[n]) for n in ("prints", "counts", "owners", "rest"))) for r in rows])


class _Probe:
    """The shards of a round; a line counts if its fingerprint stands at its index and `least` documents or more hold it."""

    def __init__(self, shared, shards: int, least: int):
        self.shards, self.least = shards, least
        self.by = {s: (PerfectHash([np.frombuffer(x, np.uint8) for x in levels]), np.frombuffer(p, np.int64), np.frombuffer(c, np.uint8), np.frombuffer(o, np.int64), np.frombuffer(r, np.int64).reshape(-1, 4)) for s, levels, p, c, o, r in shared.value}

    def owners(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which lines enough documents hold, and the largest id among them."""
        hit, owner = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        shard = ((a >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int64)
        for s in np.unique(shard).tolist():
            if s in self.by:
                made, prints, counts, owners, rest = self.by[s]
                at = np.flatnonzero(shard == s)
                for x, y, n, o in rest.tolist():
                    same = at[(a[at].view(np.int64) == x) & (b[at].view(np.int64) == y)]
                    hit[same], owner[same] = n >= self.least, o
                index = made.index(a[at])
                ok = index >= 0
                at, index = at[ok], index[ok]
                same = (prints[index] == b[at].view(np.int64)) & (counts[index] >= self.least)
                hit[at[same]], owner[at[same]] = True, owners[index[same]]
        return hit, owner


def _probe_part(part: pa.RecordBatch, id_col: str, text_col: str, least: int, probe: _Probe) -> tuple[list[list[str]], list[set[int]]]:
    all_lines, doc, at, a, b = [], [], [], [], []
    ids = [(_LOW if x is None else int(x)) for x in part.column(id_col).to_pylist()]
    for i, text in enumerate(part.column(text_col).to_pylist()):
        lines, own, ka, kb = line_keys(text or "", least)
        all_lines.append(lines)
        doc += [i] * len(own)
        at += own
        a += ka
        b += kb
    fallen: list[set[int]] = [set() for _ in all_lines]
    if a:
        hit, owner = probe.owners(np.array(a, np.uint64), np.array(b, np.uint64))
        for k in np.flatnonzero(hit).tolist():
            if owner[k] != ids[doc[k]]:
                fallen[doc[k]].add(at[k])
    return all_lines, fallen


def _fallen(marked: DataFrame, id_col: str, text_col: str, least: int, shared, shards: int, docs_least: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _Probe(shared, shards, docs_least)
        for batch in batches:
            for part in pieces(batch, text_col):
                _, fallen = _probe_part(part, id_col, text_col, least, probe)
                hit = [i for i, x in enumerate(fallen) if x]
                row = part.column("__row").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for i in hit], pa.int64()), pa.array([sorted(fallen[i]) for i in hit], pa.list_(pa.int32()))], names=["__row", "__fallen"])

    return marked.select("__row", id_col, text_col).mapInArrow(run, "__row long, __fallen array<int>")


def _finish(docs: DataFrame, id_col: str, text_col: str, least: int, shared, shards: int, docs_least: int, given: str | None) -> DataFrame:
    keep = [c for c in docs.columns if c != given]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = None if given else _Probe(shared, shards, docs_least)
        for batch in batches:
            for part in pieces(batch, text_col):
                if given:
                    all_lines = [(x or "").split("\n") for x in part.column(text_col).to_pylist()]
                    fallen = [set(x or ()) for x in part.column(given).to_pylist()]
                else:
                    all_lines, fallen = _probe_part(part, id_col, text_col, least, probe)
                kept = ["\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else "\n".join(lines) for lines, gone in zip(all_lines, fallen, strict=True)]
                made = [pa.array([len(x) for x in all_lines], pa.int64()), pa.array([len(x) for x in fallen], pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=schema.names)

    return docs.mapInArrow(run, schema)
