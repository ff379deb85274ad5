"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a byte trie. A node's failure link leads to the node of what is left once all pieces that longest
match would surely take are popped, and the number of those pieces is kept with the link. Reading a word moves
through each byte once and follows failure links where no arc leads on; the pops along the way add up to the length
of the greedy split, and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship
from .bpe import _Table, load
from .common import Words, built, lean, pieces, span_hashes

#: Words whose lengths a worker remembers; more than these are worked out again, never wrongly.
REMEMBERED = 300_000


class LongestMatch:
    """Words begin with `mark`; pieces inside a word don't. Every single byte must be a piece."""

    def __init__(self, vocabulary: list[bytes], mark: bytes = b" "):
        self.mark = mark
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    final.append(False)
                node = nxt
            final[node] = bool(piece)
        missing = [b for b in range(256) if not (b in children[0] and final[children[0][b]])]
        if missing:
            raise ValueError(f"bytes that are no pieces: {missing[:5]}")
        fail, pops = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in children[u].items():
                if final[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and b not in children[z]:
                        n += pops[z]
                        z = fail[z]
                    fail[v], pops[v] = (children[z][b] if z >= 0 else -1), n
                queue.append(v)
        arcs = [(u << 8 | b, v) for u, c in enumerate(children) for b, v in c.items()]
        self.arcs = _Table(np.array([a for a, _ in arcs], np.int64), np.array([v for _, v in arcs], np.int32))
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        self.start = 0
        self.memo = _Table(np.zeros(0, np.int64), np.zeros(0, np.int32), 1 << 16)

    def _step(self, state: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = self.arcs.get(state << 8 | byte).astype(np.int64)
        left = np.flatnonzero(out < 0)
        state = state[left]
        while len(left):
            count[left] += self.pops[state]
            state = self.fail[state]
            nxt = self.arcs.get(state << 8 | byte[left]).astype(np.int64)
            out[left] = nxt
            more = nxt < 0
            left, state = left[more], state[more]
        return out

    def lengths(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of greedy pieces of each word, mark included; all words move through the automaton together."""
        n = end - begin
        order = np.argsort(n, kind="stable")
        sizes, begin = n[order], begin[order]
        count, state = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for b in self.mark:
            state = self._step(state, np.full(len(n), b, np.int64), count)
        for p in range(int(sizes[-1]) if len(n) else 0):
            tail = np.searchsorted(sizes, p, "right")
            part = count[tail:]
            state[tail:] = self._step(state[tail:], data[begin[tail:] + p].astype(np.int64), part)
        live = np.flatnonzero(state > 0)
        while len(live):
            count[live] += self.pops[state[live]]
            state[live] = self.fail[state[live]]
            live = live[state[live] > 0]
        out = np.empty(len(n), np.int64)
        out[order] = count
        return out

    def word_lengths(self, words: Words) -> np.ndarray:
        """lengths() of every word of a slice, each distinct word worked out once while it is remembered."""
        code = (span_hashes(words.data, words.begin, words.end) >> np.uint64(1)).view(np.int64)
        code, one, back = np.unique(code, return_index=True, return_inverse=True)
        got = self.memo.get(code)
        new = np.flatnonzero(got < 0)
        if len(new):
            if len(self.memo) + len(new) > REMEMBERED:
                self.memo = _Table(np.zeros(0, np.int64), np.zeros(0, np.int32), 1 << 16)
            got[new] = self.lengths(words.data, words.begin[one[new]], words.end[one[new]])
            self.memo.add(code[new], got[new])
        return got[back].astype(np.int64)


def _matcher(shared) -> LongestMatch:
    return built("tokencount", hash(tuple(shared.value)), lambda: LongestMatch(shared.value))


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The given columns with n_words, n_tokens and longest_word (pieces of the word with most), all long.

    Words are `[^\\x20\\x09-\\x0D]+`; each is split as a space followed by its UTF-8 bytes, longest piece first. The
    vocabulary is that of the byte-level file at `path` (its size bounds the broadcast). Null, empty and white texts
    have 0 words and 0 tokens; very long texts and words are taken whole (a long word costs one round a byte); rows that
    repeat are rows of their own; an empty table gives no rows. Input columns named as the new ones are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    arcs, _, added = load(path)
    special = set(added.values())
    shared = spark.sparkContext.broadcast([a for i, a in enumerate(arcs) if a and i not in special])
    new = ["n_words", "n_tokens", "longest_word"]
    docs = docs.drop(*new)

    @functools.partial(lean, keeps="tokencount")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _matcher(shared)
        for batch in batches:
            for part in pieces(batch, text, 1 << 20):
                words = Words(part.column(text))
                size = match.word_lengths(words)
                total = np.concatenate(([0], np.cumsum(size)))
                n = np.diff(words.first)
                most = np.zeros(len(n), np.int64)
                full = np.flatnonzero(n)
                if len(full):
                    most[full] = np.maximum.reduceat(size, words.first[:-1][full])
                made = [n.astype(np.int64), np.diff(total[words.first]), most]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, made)], names=[*part.schema.names, *new])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in new)]))
