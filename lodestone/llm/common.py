"""Shared vectorised text handling for Arrow batches: word boundaries, word hashes, window hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def give_back() -> None:
    """Return what this Python worker has freed to the machine; workers are reused, and what they keep adds up over stages."""
    for powers in (*_BYTE_POWERS.values(), *_WORD_POWERS.values()):
        powers.up = powers.down = np.ones(1, U64)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


#: The tables that one operator has built in this worker for later partitions.
_BUILT: dict[str, tuple[object, object]] = {}


def built(owner: str, key: object, make: Callable[[], object]) -> object:
    """What `make` gives, kept in this worker until another operator runs in it."""
    if _BUILT.get(owner, (None, None))[0] != key:
        _BUILT.clear()
        _BUILT[owner] = (key, make())
    return _BUILT[owner][1]


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Batches, keeps: str = "") -> Batches:
    """The function over batches; it drops what other operators than `keeps` have built and gives back its memory when the partition is done."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner in [o for o in _BUILT if o != keeps]:
            del _BUILT[owner]
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 20)) * U64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when a longer buffer comes."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(m, b, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = {0: _Powers(0x9E3779B97F4A7C13), 1: _Powers(0xD1342543DE82EF93)}
_WORD_POWERS = {0: _Powers(0xA0761D6478BD642B), 1: _Powers(0xE7037ED1A0B428DB)}
_BYTE_CODES = {k: stream(11 + k, 256) for k in (0, 1)}


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts (one more offset than texts); nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each (a longer single text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a slice of texts, as byte spans of one buffer.

    data: bytes, each text followed by one space; begin, end: a word's span; first: index of each text's
    first word (one more entry than texts).
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        padded = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        data, off = buffers(padded)
        self.data = LOWER[data] if lower else data
        solid = np.empty(len(data) + 1, bool)
        solid[0] = False
        np.logical_not(_IS_WHITE[data], out=solid[1:])
        turn = np.flatnonzero(solid[1:] != solid[:-1])
        self.begin, self.end = turn[0::2], turn[1::2]
        self.offsets = off
        self.first = np.searchsorted(self.begin, off)
        self.first[-1] = len(self.begin)

    def __len__(self) -> int:
        return len(self.begin)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.begin, self.end, which)

    def owner(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    up, down = _BYTE_POWERS[which].get(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_CODES[which][data] * up[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64))


def window_hashes(words: np.ndarray, begin: np.ndarray, length: int | np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the windows of `length` consecutive word hashes that start at `begin`."""
    up, down = _WORD_POWERS[which].get(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[begin + length] - total[begin]) * down[begin] + np.asarray(length).astype(U64))


def window_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and text index of every full window inside one text."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate(([0], np.cumsum(counts)))[:-1]
    start = np.arange(len(owner)) - before[owner] + first[:-1][owner]
    return start, owner


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
