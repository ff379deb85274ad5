"""Byte-pair encoding by a deterministic automaton over tokens.

A BPE merge list is compiled merge by merge. The automaton starts with one state in which every byte is an arc. The
gadget of merge (u, v) -> w copies the state that u leads to, takes the arc v out of the copy, leads u into the
copy, and lets w follow wherever u followed and lead where v led. All arcs of one label lead to one state, so a
state is kept as a chain: the label, then the labels along its right edge, each with the merge before which its
lost arcs count. A token sequence is the tokenization of its bytes exactly if each token is an arc of the state its
predecessor leads to. Every prefix of a word has one such sequence, so encoding walks the vocabulary's byte trie
from each position once and keeps the only token that may end at each place. Decoding emits the arcs' bytes.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import buffers, lean, pieces, span_hashes

#: Fixed: the published pre-splitting pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
#: Words whose ids a worker remembers; more than these are worked out again, never wrongly.
REMEMBERED = 200_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: visible Latin-1 as it is, the rest from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> tuple[list[bytes], list[tuple[int, int, int]], dict[str, int]]:
    """Of a byte-level BPE file: each id's bytes, merges (u, v, w) by id in order, and its added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    arcs = [b""] * (max([*vocab.values(), *added.values()], default=-1) + 1)
    for piece, i in vocab.items():
        if piece not in added:
            arcs[i] = bytes(letters[c] for c in piece)
    for piece, i in added.items():
        arcs[i] = piece.encode()
    merges = []
    for m in spec["model"]["merges"]:
        u, v = m if isinstance(m, list) else m.split(" ")
        merges.append((vocab[u], vocab[v], vocab[u + v]))
    return arcs, merges, added


def _merged(arcs: int, merges: list[tuple[int, int, int]]) -> tuple[list, list, dict[int, dict[int, int]], set[int]]:
    """Merge gadgets one by one: the right and left edges of every label, the arcs that states lost, and the labels made."""
    never = len(merges)
    lost: dict[int, dict[int, int]] = {}  # label -> {arc that its state lost: merge that took it}
    right = [((i, never),) for i in range(arcs)]  # the state that a label leads to
    left = [((i, never),) for i in range(arcs)]  # where a label came in as an arc

    def follows(x: int, y: int) -> bool:
        return not any((k := lost.get(a, {}).get(z)) is not None and k < before and k <= upto for a, before in right[x] for z, upto in left[y])

    made: set[int] = set()
    for k, (u, v, w) in enumerate(merges):
        if w in made or not follows(u, v):
            continue  # such a merge never fires: no state that u leads to has the arc v
        made.add(w)
        right[w] = ((w, never), (v, k), *((a, min(t, k)) for a, t in right[v][1:]))
        left[w] = ((w, never), (u, k), *left[u][1:])
        lost.setdefault(u, {})[v] = k
    return right, left, lost, made


def _flat(chains: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of pairs as arrays: where each begins, first and second members."""
    begin = np.concatenate(([0], np.cumsum([len(c) for c in chains])))
    pairs = np.array(list(itertools.chain.from_iterable(chains)), np.int64).reshape(-1, 2)
    return begin, pairs[:, 0].copy(), pairs[:, 1].copy()


class Automaton:
    """The compiled automaton as arrays, small enough to broadcast.

    The transition table is kept by what it lacks: from the state of token x every arc y leads on, unless a merge took
    it (see follows). What a worker works out is remembered beside it and never sent.
    """

    def __init__(self, arcs: list[bytes], merges: list[tuple[int, int, int]], added: dict[str, int]):
        self.added = added
        right, left, lost, made = _merged(len(arcs), merges)
        self.right, self.left = _flat(right), _flat(left)
        taken = [(u << 20 | v, k) for u, found in lost.items() for v, k in found.items()]
        self.lost = _Table(np.array([x for x, _ in taken], np.int64), np.array([k for _, k in taken], np.int32))
        self.pieces = np.frombuffer(b"".join(arcs), np.uint8)
        self.piece_at = np.concatenate(([0], np.cumsum([len(a) for a in arcs])))
        trie: dict[int, int] = {}
        token: list[int] = [-1]
        for i, piece in enumerate(arcs):
            if not piece or (len(piece) > 1 and i not in made) or i in added.values():
                continue
            node = 0
            for c in piece:
                key = node << 8 | c
                node = trie.get(key, 0)
                if not node:
                    node = trie[key] = len(token)
                    token.append(-1)
            token[node] = i
        self.arcs_by = _Table(np.fromiter(trie.keys(), np.int64, len(trie)), np.fromiter(trie.values(), np.int32, len(trie)))
        self.token_of = np.array(token, np.int32)
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.memo, self.memo_pool, self.memo_size = _Table(*none, 1 << 16), none[1], none[0]
        self.known = _Table(*none, 1 << 17)
        self.trie: dict[int, int] = {}
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "memo_pool", "memo_size", "known", "trie", "added_split")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def follows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the state that x leads to has the arc y, for many pairs: no merge of a label on x's right edge with one
        on y's left edge came before both edges were merged on."""
        out = np.ones(len(x), bool)
        (rb, ra, rt), (lb, la, lt) = self.right, self.left
        for i in range(0, len(x), 1 << 14):
            p, q = x[i : i + (1 << 14)].astype(np.int64), y[i : i + (1 << 14)].astype(np.int64)
            wide = lb[q + 1] - lb[q]
            n = (rb[p + 1] - rb[p]) * wide
            pair = np.repeat(np.arange(len(p)), n)
            inner = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            r, z = rb[p][pair] + inner // wide[pair], lb[q][pair] + inner % wide[pair]
            k = self.lost.get(ra[r] << 20 | la[z])
            out[i + pair[(k >= 0) & (k < rt[r]) & (k <= lt[z])]] = False
        return out

    def word(self, raw: bytes) -> tuple[int, ...]:
        """The ids of one long word. Each prefix has one correct sequence, hence one last token."""
        if not self.trie:
            kept = self.arcs_by.keys >= 0
            self.trie = dict(zip(self.arcs_by.keys[kept].tolist(), self.arcs_by.values[kept].tolist(), strict=True))
        n, pairs, token = len(raw), {}, self.token_of
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            node, j, before = 0, i, last[i]
            while j < n:
                node = self.trie.get(node << 8 | raw[j])
                if node is None:
                    break
                j += 1
                t = int(token[node])
                if t >= 0 and last[j] < 0:
                    ok = not i or pairs.get(before << 20 | t)
                    if ok is None:
                        ok = pairs[before << 20 | t] = bool(self.follows(np.array([before]), np.array([t]))[0])
                    if ok:
                        last[j], start[j] = t, i
        out, j = [], n
        while j:
            out.append(last[j])
            j = start[j]
        return tuple(reversed(out))

    def decode(self, ids: list[int]) -> str:
        """The arcs' bytes as UTF-8; what isn't becomes U+FFFD."""
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_batch(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of many sequences, one after the other in ids."""
        begin = self.piece_at[ids]
        n = self.piece_at[ids.astype(np.int64) + 1] - begin
        until = np.concatenate(([0], np.cumsum(n)))
        data = self.pieces[np.repeat(begin - until[:-1], n) + np.arange(until[-1])].tobytes()
        cut = until[first].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(cut)]

    def _may_follow(self, before: np.ndarray, t: np.ndarray) -> np.ndarray:
        """follows() of many pairs, each distinct pair worked out once while it is remembered."""
        key = before.astype(np.int64) << 20 | t
        got = self.known.get(key)
        new = np.unique(key[got < 0])
        if len(new):
            if len(self.known) + len(new) > 400_000:
                self.known = _Table(np.zeros(0, np.int64), np.zeros(0, np.int32), 1 << 17)
                new = np.unique(key)
            self.known.add(new, self.follows(new >> 20, new & 0xFFFFF).astype(np.int32))
            got = self.known.get(key)
        return got > 0

    def encode_words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, one after the other, and how many each has: word() in lockstep over all words.

        Words of more than 64 bytes go through word() one by one.
        """
        n = end - begin
        slow = n > 64
        room = np.where(slow, 0, n + 1)
        base = np.cumsum(room) - room
        last, start = np.full(int(room.sum()), -1, np.int32), np.zeros(int(room.sum()), np.int64)
        order = np.argsort(np.where(slow, 0, n), kind="stable")  # by length: those that reach a place are a tail
        sizes = np.where(slow, 0, n)[order]
        for p in range(int(sizes[-1]) if len(sizes) else 0):
            who = order[np.searchsorted(sizes, p, "right") :]
            at, stop = begin[who] + p, end[who]
            cell = base[who] + p
            before = last[cell]
            node, d = np.zeros(len(who), np.int64), 0
            while len(cell):
                node = self.arcs_by.get(node << 8 | data[at + d])
                found = np.flatnonzero(node >= 0)
                node, at, stop, cell, before = node[found].astype(np.int64), at[found], stop[found], cell[found], before[found]
                d += 1
                t = self.token_of[node]
                new = np.flatnonzero((t >= 0) & (last[cell + d] < 0))
                if p and len(new):
                    new = new[self._may_follow(before[new], t[new])]
                last[cell[new] + d], start[cell[new] + d] = t[new], p
                more = np.flatnonzero(at + d < stop)
                node, at, stop, cell, before = node[more], at[more], stop[more], cell[more], before[more]
        live = np.flatnonzero(~slow)
        j = n[live]
        owners, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        while len(live):
            cell = base[live] + j
            owners.append(live)
            tokens.append(last[cell])
            j = start[cell]
            live, j = live[j > 0], j[j > 0]
        for i in np.flatnonzero(slow).tolist():
            ids = self.word(data[begin[i] : end[i]].tobytes())
            owners.append(np.full(len(ids), i))
            tokens.append(np.array(ids[::-1], np.int32))
        owner, token = np.concatenate(owners)[::-1], np.concatenate(tokens)[::-1]
        return token[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(begin))

    def _ids(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has; each distinct word is worked out once while it is remembered."""
        code = (span_hashes(data, begin, end) >> np.uint64(1)).view(np.int64)
        code, one, back = np.unique(code, return_index=True, return_inverse=True)
        which = self.memo.get(code)
        new = np.flatnonzero(which < 0)
        if len(new):
            if len(self.memo) + len(new) > REMEMBERED:
                self.memo, self.memo_pool, self.memo_size = _Table(np.zeros(0, np.int64), np.zeros(0, np.int32), 1 << 16), np.zeros(0, np.int32), np.zeros(0, np.int64)
                new = np.arange(len(code))
            ids, size = self.encode_words(data, begin[one[new]], end[one[new]])
            self.memo_pool, self.memo_size = np.concatenate((self.memo_pool, ids)), np.concatenate((self.memo_size, size))
            which[new] = len(self.memo) + np.arange(len(new), dtype=np.int32)
            self.memo.add(code[new], which[new])
        place = (np.cumsum(self.memo_size) - self.memo_size)[which][back]
        width = self.memo_size[which][back]
        until = np.cumsum(width)
        return self.memo_pool[np.repeat(place - (until - width), width) + np.arange(until[-1] if len(until) else 0)], width

    def _of_strings(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        until = np.concatenate(([0], np.cumsum([len(w) for w in raw]))).astype(np.int64)
        return self._ids(np.frombuffer(b"".join(raw), np.uint8), until[:-1], until[1:])

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; strings of added tokens stand for themselves."""
        out = [np.zeros(0, np.int32)]
        for part in self.added_split.split(text) if self.added_split else [text]:
            if part in self.added:
                out.append(np.array([self.added[part]], np.int32))
            elif part:
                out.append(self._of_strings(_SPLIT.findall(part))[0])
        return np.concatenate(out)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, and where each text's ids begin (one more entry than texts).

        Texts of ASCII and Latin-1 letters without apostrophes are split by byte classes, others by the pattern; the
        words of both are worked out together. Texts that hold a string of an added token are taken one by one.
        """
        data, off = buffers(texts)
        odd = np.zeros(len(off) - 1, bool)
        np.logical_or.at(odd, np.searchsorted(off, np.flatnonzero(_ODD[data]), "right") - 1, True)
        special: dict[int, np.ndarray] = {}
        words: list[str] = []
        owner = [np.zeros(0, np.int64)]
        raw = data.tobytes() if self.added else b""
        if any(a.encode() in raw for a in self.added):
            for i, text in enumerate(texts.to_pylist()):
                if text and any(a in text for a in self.added):
                    special[i], odd[i] = self.encode(text), True
        for i in np.flatnonzero(odd).tolist():
            if i not in special:
                found = _SPLIT.findall(texts[i].as_py())
                words += found
                owner.append(np.full(len(found), i))
        begin = split_plain(data, off)
        end = np.append(begin[1:], len(data))
        plain = np.searchsorted(off, begin, "right") - 1
        keep = ~odd[plain]
        parts = [self._ids(data, begin[keep], end[keep]), self._of_strings(words)]
        of = [np.repeat(plain[keep], parts[0][1]), np.repeat(np.concatenate(owner), parts[1][1])]
        of += [np.full(len(x), i) for i, x in special.items()]
        ids = np.concatenate([parts[0][0], parts[1][0], *special.values()])
        of = np.concatenate(of)
        if words or special:
            ids = ids[np.argsort(of, kind="stable")]
        return ids, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(odd)))))


class _Table:
    """Non-negative 64-bit keys to 32-bit values in an open-addressing table that is probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, least: int = 1 << 10):
        self.n, bits = 0, max(least, 4 * len(keys)).bit_length()
        self.mask = (1 << bits) - 1
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        self.add(keys, values)

    def __len__(self) -> int:
        return self.n

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put distinct new keys in."""
        if 3 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            self.__init__(np.concatenate((self.keys[old], keys)), np.concatenate((self.values[old], values)))
            return
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            done = np.zeros(len(keys), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + (self.keys[slot[left]] != keys[left])) & self.mask
        self.n += len(keys)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 for those that aren't there."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out


#: Classes of bytes: 0 space, 1 other white space, 2 letter, 3 digit, 4 other; _ODD marks bytes the plain split leaves to the pattern.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[32], _CLASS[[9, 10]] = 0, 1
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 2
_CLASS[48:58] = 3
_ODD = np.zeros(256, bool)
_ODD[[*(b for b in range(32) if b not in (9, 10)), 39, 127, 0x97, 0xB7, *(b for b in range(0xC0, 256) if b != 0xC3)]] = True


def split_plain(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pre-split words of plain texts begin (the classes of PATTERN without contractions)."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[off] = True
    opens, closes = opens[:-1], opens[1:]
    before = np.concatenate(([9], kind[:-1])).astype(np.uint8)
    after = np.concatenate((kind[1:], [9])).astype(np.uint8)
    white = kind <= 1
    run = white & (opens | (before > 1))
    last = white & (after > 1) & ~closes
    solid = ~white & (opens | (before == 1) | ((before > 1) & (before != kind)))
    return np.flatnonzero(run | last | solid | opens)


def encode_decode(docs: DataFrame, path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """The given columns plus n_tokens long, ids_sha256, decoded_sha256 and, if with_ids, ids array<int>.

    Null and empty texts have no tokens; a very long text or word is encoded whole; rows that repeat are rows of their own;
    an empty table gives no rows. Input columns named as the new ones are replaced. The vocabulary file at `path` is read
    and compiled by the driver and sent to the executors; its size bounds the broadcast.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Automaton(*load(path)))
    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if with_ids:
        new.append(("ids", T.ArrayType(T.IntegerType())))
    docs = docs.drop(*(x[0] for x in new))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        names = list(map(str, range(len(auto.piece_at) - 1)))
        for batch in batches:
            for part in pieces(batch, text):
                flat, first = auto.encode_batch(part.column(text))
                tokens = list(map(names.__getitem__, flat.tolist()))
                written = [hashlib.sha256(",".join(tokens[a:b]).encode()).hexdigest() for a, b in itertools.pairwise(first.tolist())]
                decoded = [hashlib.sha256(x.encode()).hexdigest() for x in auto.decode_batch(flat, first)]
                made = [pa.array(np.diff(first)), pa.array(written, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(x[0] for x in new)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in new)]))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
