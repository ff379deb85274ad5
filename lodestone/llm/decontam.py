"""Benchmark decontamination by shared byte runs, banded windows and exact edit distance.

An item within k edits of a part of a document shares at least one unedited run of ceil((m - k) / (k + 1)) of its m
bytes with it, and of random edits nearly always a longer one. Every byte of documents and items begins a run; an
item's runs are as long (LONGEST at most) as leaves a chance of MISS at its greatest number of random edits that none
is shared, and never longer than the bound where that can't be met. Equal runs make candidates. Of each, WINDOWS
of the item around the run are searched in the document by batched bit-parallel edit distance: an item that fits
in the window with its own limit, a longer one with SPARE percent more, as edits may cluster. What is left has the
part of the document where the whole item would lie searched by exact edit distance.

Items that fit in the window are so found without loss. Longer ones can be missed if edits break every run or crowd
around all shared ones; tests measure recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Words, lean, pieces

#: Longest run looked up; chance that random edits at the limit leave no shared run; bytes of the windows around a run, one
#: after the other; percent of a window that edits may take beyond the limit; bits of the filter before the exact lookup.
LONGEST, MISS, WINDOWS, SPARE, FILTER_BITS = 8, 0.003, (24, 48), 12, 20
#: Items are taken in blocks of this many bytes, so that what one scan broadcasts is bounded.
BLOCK_BYTES = 2 << 20
#: Candidates and windows that are held at once.
MANY, FEW = 1 << 18, 1 << 12
#: Bytes before and after the documents that windows at their ends may reach.
PAD = 2 * WINDOWS[-1]


def squeeze(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words joined by one space, one text after the other: bytes, where words begin, where texts begin."""
    data = words.data.copy()
    data[words.end] = 32
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.begin] += 1
    edge[words.end + 1] -= 1
    size = np.concatenate(([0], np.cumsum(words.end + 1 - words.begin)))
    return data[np.cumsum(edge[:-1]) > 0], size[:-1], size[words.first]


def run_length(m: int, percent: int) -> int:
    """How long the runs of an item of m bytes are."""
    k = m * percent // 100
    for q in range(min(m, LONGEST), 0, -1):
        if q <= -(-(m - k) // (k + 1)) or (1 - (1 - percent / 100) ** q) ** (k + 1) <= MISS:
            return q
    return 1


def runs(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place (zeros after the end) as an integer, the first byte lowest."""
    out = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    for n in (1, 2, 4):
        out[:-n] |= out[n:] << np.uint64(8 * n)
    return out[: len(data)]


def first_bytes(run: np.ndarray, q: int) -> np.ndarray:
    return run if q == 8 else run & np.uint64((1 << 8 * q) - 1)


def _filter_at(run: np.ndarray) -> np.ndarray:
    return (run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def best_place(item: bytes, region: bytes) -> tuple[int, int]:
    """Least edit distance between the item and any part of the region, and where the best part ends (bit-parallel)."""
    at = region.find(item)
    if at >= 0:
        return 0, at + len(item)
    m = len(item)
    eq: dict[int, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, where = full, 0, m, m, 0
    for j, c in enumerate(region):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, where = score, j + 1
    return best, where


class Index:
    """The runs of a block of items."""

    def __init__(self, items: list[tuple[int, str]], percent: int = 20):
        texts = pa.array([t for _, t in items], pa.string())
        data, _, off = squeeze(Words(texts, lower=True))
        self.ids, self.percent = [i for i, _ in items], percent
        raw = data.tobytes()
        self.raw = [raw[a : max(a, b - 1)] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        self.data, self.off = data, off[:-1]
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.most = self.size * percent // 100
        owner = np.repeat(np.arange(len(items)), np.diff(off))
        left = self.off[owner] + self.size[owner] - np.arange(len(data))
        length = np.array([run_length(m, percent) for m in self.size.tolist()], np.int64)
        self.classes, every = [], runs(data)
        for q in np.unique(length[self.size > 0]).tolist():
            at = np.flatnonzero((length[owner] == q) & (left >= q))
            run = first_bytes(every[at], q)
            order = np.argsort(run, kind="stable")
            flags = np.zeros(1 << FILTER_BITS, bool)
            flags[_filter_at(run)] = True
            self.classes.append((q, run[order], at[order], owner[at[order]], flags))
        # Row c, column p // 8: in which of the 64 places from p on (p divisible by 8) stands a byte of code c.
        self.columns = len(data) // 8 + 1
        bits = np.zeros((64, self.columns + 8), np.uint8)
        for c in range(64):
            packed = np.packbits((data & 63) == c, bitorder="little")
            bits[c, : len(packed)] = packed
        wide = np.zeros((64, self.columns), np.uint64)
        for j in range(8):
            wide |= bits[:, j : self.columns + j].astype(np.uint64) << np.uint64(8 * j)
        self.equal = wide.reshape(-1)

    def candidates(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Places in the documents, places in the items' bytes and items with an equal run, and its length; MANY or one place's at a time."""
        every = runs(data)
        for q, own, at, owner, flags in self.classes:
            run = first_bytes(every, q)
            mine = np.flatnonzero(flags[_filter_at(run)])
            # Sorted lookups stay in the cache.
            value, back = np.unique(run[mine], return_inverse=True)
            low = np.searchsorted(own, value, "left")
            n = (np.searchsorted(own, value, "right") - low)[back]
            low = low[back]
            mine, low, n = mine[n > 0], low[n > 0], n[n > 0]
            total, a = np.cumsum(n), 0
            while a < len(mine):
                done = total[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(total, done + MANY, "right")))
                part = n[a:b]
                theirs = np.repeat(low[a:b] - (np.cumsum(part) - part), part) + np.arange(part.sum())
                yield np.repeat(mine[a:b], part), at[theirs], owner[theirs], q
                a = b

    def near(self, code: np.ndarray, pos: np.ndarray, place: np.ndarray, item: np.ndarray, q: int) -> np.ndarray:
        """Which candidates have the windows around their run within their limits in the document."""
        size, most = self.size[item], self.most[item]
        short = size <= WINDOWS[-1]
        out = np.zeros(len(pos), bool)
        for m in np.unique(size[short]).tolist():
            x = np.flatnonzero(size == m)
            limit = int(most[x[0]])
            out[x] = self._within(code, pos[x] - (place[x] - self.off[item[x]]) - limit, self.off[item[x]], m, limit, m + 2 * limit)
        x = np.flatnonzero(~short)
        for m in WINDOWS:
            limit = m * (self.percent + SPARE) // 100
            slack = 2 * limit // 3  # the run fixes where the window lies but for the edits to one side
            own = self.off[item[x]]
            first = np.clip(place[x] - (m - q) // 2, own, own + size[x] - m)
            x = x[self._within(code, pos[x] - (place[x] - first) - slack, first, m, limit, m + 2 * slack)]
        out[x] = True
        return out

    def _within(self, code: np.ndarray, begin: np.ndarray, first: np.ndarray, m: int, limit: int, steps: int) -> np.ndarray:
        """Whether the m item bytes from `first` are within the limit of any part of the `steps` document bytes from `begin`.

        Bits above the m lowest are never read, so nothing masks them.
        """
        out = np.zeros(len(begin), bool)
        kind = np.uint32 if m <= 32 else np.uint64
        one, top = kind(1), kind(m - 1)
        for a in range(0, len(begin), FEW):
            at = begin[a : a + FEW] + PAD
            column, shift = first[a : a + FEW] >> 3, (first[a : a + FEW] & 7).astype(np.uint64)
            n = len(at)
            pv, mv, score = np.full(n, ~kind(0)), np.zeros(n, kind), np.full(n, m, kind)
            best = score.copy()
            place, wide, e, xv, xh, ph, mh = np.empty(n, np.int64), np.empty(n, np.uint64), *(np.empty(n, kind) for _ in range(5))
            for j in range(steps):
                np.take(code, at, out=place, mode="clip")
                at += 1
                place += column
                np.take(self.equal, place, out=wide, mode="clip")
                np.right_shift(wide, shift, out=wide)
                np.copyto(e, wide, casting="unsafe")
                np.bitwise_or(e, mv, out=xv)
                np.bitwise_and(e, pv, out=xh)
                xh += pv
                xh ^= pv
                xh |= e
                np.bitwise_or(xh, pv, out=ph)
                np.invert(ph, out=ph)
                ph |= mv
                np.bitwise_and(pv, xh, out=mh)
                np.right_shift(ph, top, out=e)
                e &= one
                score += e
                np.right_shift(mh, top, out=e)
                e &= one
                score -= e
                ph <<= one
                mh <<= one
                np.bitwise_or(xv, ph, out=pv)
                np.invert(pv, out=pv)
                pv |= mh
                np.bitwise_and(ph, xv, out=mv)
                if j >= m - limit - 1:
                    np.minimum(best, score, out=best)
            out[a : a + FEW] = best <= kind(limit)
        return out

    def hits(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, byte of the squeezed text where the best match ends), least distance of each pair."""
        data, _, off = squeeze(Words(texts, lower=True))
        if not len(data):
            return []
        code = np.pad((data & 63).astype(np.int64) * self.columns, PAD)
        found = []
        for pos, place, item, q in self.candidates(data):
            # Of runs one after the other on one diagonal the first is taken, and those at every eighth byte of the item.
            inner = place - self.off[item]
            one = (inner & 7 == 0) | (pos == 0)
            one |= data[pos - 1] != self.data[place - 1]
            pos, place, item, inner = pos[one], place[one], item[one], inner[one]
            ok = self.near(code, pos, place, item, q)
            doc = np.searchsorted(off, pos[ok], "right") - 1
            # Nearby alignments of one pair share a search: its region reaches a quarter of the item to both sides.
            grain = np.maximum(self.size[item[ok]] // 8, 1)
            found.append(np.unique(np.column_stack((doc, item[ok], (pos - inner)[ok] // grain)), axis=0))
        if not found:
            return []
        raw, best = data.tobytes(), {}
        for d, i, p in np.unique(np.concatenate(found), axis=0).tolist():
            own, most = self.raw[i], int(self.most[i])
            if best.get((d, i), (most + 1,))[0] == 0:
                continue
            slack, grain_i = len(own) // 4 + 8, max(len(own) // 8, 1)
            a, b = max(off[d], p * grain_i - slack), min(off[d + 1] - 1, (p + 1) * grain_i + len(own) + slack)
            distance, end = best_place(own, raw[a:b])
            if distance <= most and distance < best.get((d, i), (most + 1,))[0]:
                best[d, i] = (distance, int(a - off[d]) + end)
        return [(d, i, *v) for (d, i), v in sorted(best.items())]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one partition at a time. Null and white texts are no items."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        if r["t"] and r["t"].strip(" \t\n\v\f\r"):
            block.append((r["i"], r["t"]))
            size += len(r["t"].encode())
            if size >= BLOCK_BYTES:
                yield block
                block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = 20) -> DataFrame:
    """Rows (doc_id, item_id, distance, item_bytes, similarity, ends_at): documents that hold an item.

    Texts are lower-cased in A-Z and their words joined by single spaces; a document holds an item if some part of it
    is within percent % of the item's bytes in edit distance. One row per row of docs and item; ends_at is the byte
    after the best match. Of equally near places the first is reported. Rows that repeat are
    reported apart; very long texts are searched whole; an empty table gives no rows; null ids are kept; null and empty texts hold nothing,
    as do all texts if the benchmark is empty. Other columns are ignored. Each block of items is one scan of docs.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, item_bytes int, similarity double, ends_at long"
    out = None
    for block in item_blocks(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        @lean
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, percent)
            for batch in batches:
                for part in pieces(batch, "text"):
                    found = index.hits(part.column("text"))
                    size = [len(index.raw[i]) for _, i, _, _ in found]
                    cols = [
                        part.column("doc_id").take(pa.array([d for d, *_ in found], pa.int64())),
                        pa.array([index.ids[i] for _, i, _, _ in found], pa.int64()),
                        pa.array([x for _, _, x, _ in found], pa.int32()),
                        pa.array(size, pa.int32()),
                        pa.array([1 - x / n for (_, _, x, _), n in zip(found, size, strict=True)], pa.float64()),
                        pa.array([e for _, _, _, e in found], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "distance", "item_bytes", "similarity", "ends_at"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
