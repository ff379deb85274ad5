"""Substring dedup by level-wise doubling.

Which windows of w words occur more than once is found in levels of doubling length, from BASE words on: ..., ceil(w / 4),
ceil(w / 2), w. A level looks only at windows that are the least (by hash) among the sub-windows of some window of the
level above: equal windows pick equal sub-windows, so nothing repeated is missed and one window in nine is counted
instead of all. Windows repeated at one length alone are extended to twice the length, that is to the windows which
picked them; the levels end once no candidate survives. Of the w-windows the ones repeated as a whole survive, and
every word they cover goes. Documents that are exact copies of each other extend once for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace, ship
from .common import Words, lean, pieces, signed, window_hashes, window_starts

_LOW = -(1 << 63)


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least value among values[i : i + width], for each i that has a full window."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        span += step
    return best[:n]


#: Shorter windows than this filter nothing that these don't: runs of fewer words repeat by chance.
BASE = 18


def lengths(window: int) -> list[int]:
    """The levels' lengths, ascending; at least two."""
    out = [window]
    while out[0] > BASE or len(out) == 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def picked(words: Words, hashes: np.ndarray, levels: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each level the starts of its windows, and (but for the first) the start of the sub-window that each picks; the
    highest level has all windows, the others those picked from above."""
    starts = [window_starts(words.first, levels[-1])[0]]
    picks: list[np.ndarray] = []
    for n, half in zip(levels[:0:-1], levels[-2::-1], strict=True):
        sub = window_hashes(hashes, np.arange(max(len(hashes) - half + 1, 0)), half)
        pick = least_in_window(sub, n - half + 1)[starts[0]] if len(starts[0]) else starts[0]
        picks.insert(0, pick)
        starts.insert(0, np.unique(pick))
    return starts, [starts[0], *picks]


def owners(words: Words, start: np.ndarray) -> np.ndarray:
    """Index of the text that each word belongs to."""
    return np.searchsorted(words.first, start, "right") - 1


def _rows(key: pa.Array, cols: list[np.ndarray], owner: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), key.take(pa.array(owner))], names=[*names, "key"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Columns doc_id, n_words, n_removed (long), kept_sha256, kept_text (string): one row per row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of `window` consecutive words of its document
    that covers it starts anywhere else too, in the same or another document; windows are judged on the input.
    kept_text joins the other words by one space. Null texts have no words; texts shorter than a window lose none.
    Rows that repeat count apart, so their windows are repeated; rows whose ids are null or repeat are told apart by
    their place in a copy of the table. Very long texts are taken whole. Other columns are ignored. An empty table
    gives no rows. Needs window >= 4.
    """
    if window < 4:
        raise ValueError("window must be 4 at least")
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "repeats")
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), ids.alias("key"))
    if not rows.select("key").groupBy("key").count().where("count > 1").isEmpty():
        rows = work.table("rows", rows.withColumn("key", F.monotonically_increasing_id()))
    levels = lengths(window)

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                hashes = words.hashes()
                at = picked(words, hashes, levels)[0][0]
                own = owners(words, at)
                yield _rows(part.column("key"), [signed(window_hashes(hashes, at, levels[0])), (at - words.first[own]).astype(np.int32)], own, ["h", "at"])

    def next_level(level: int, which: tuple[int, ...]):
        """Windows of a level whose picks are alive: their hashes, place and how many copies speak through them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "text"):
                    words = Words(part.column("text"))
                    hashes = words.hashes()
                    starts, chosen = picked(words, hashes, levels)
                    live = np.zeros(len(words) + 1, bool)
                    picks = part.column("picks")
                    of = np.repeat(np.arange(len(picks)), np.diff(picks.offsets.to_numpy()))
                    live[np.minimum(picks.flatten().to_numpy(zero_copy_only=False) + words.first[:-1][of], len(words))] = True
                    start = starts[level][live[chosen[level]]]
                    own = owners(words, start)
                    n = part.column("copies").to_numpy(zero_copy_only=False)[own]
                    code = [signed(window_hashes(hashes, start, levels[level], w)) for w in which]
                    yield _rows(part.column("key"), [*code, (start - words.first[own]).astype(np.int32), n], own, ["h", "g"][: len(which)] + ["at", "n"])

        return lean(run)

    marks = rows.select("key", F.md5(F.coalesce("text", F.lit(""))).alias("m"))
    # A table of its own, so that both sides of the join are shuffled for it and a hot text's rows can be split.
    groups = work.table("groups", marks.groupBy("m").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("speaker")).where("copies > 1"))
    copies = work.table("copies", marks.join(groups, "m").select("key", "copies", (F.col("key") == F.col("speaker")).cast("int").alias("speaks")))

    seen = work.table("level0", rows.select("key", "text").mapInArrow(lean(first_level), "h long, at int, key long"))
    for level in range(1, len(levels)):
        # Copies of one text are all counted at the first level, so its own windows are alive there.
        counted = seen.groupBy("h").agg((F.count(F.lit(1)) if level == 1 else F.sum("n")).alias("n")).where("n > 1").select("h")
        repeated = work.table(f"repeated{level}", counted)
        alive = work.table(f"alive{level}", seen.join(repeated, "h", "left_semi").groupBy("key").agg(F.collect_list("at").alias("picks")))
        work.drop(f"level{level - 1}", f"repeated{level}")
        # A copied text has one speaker from the second level on.
        extend = alive.join(copies, "key", "left").where("speaks is null or speaks = 1").select("key", "picks", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
        top = level == len(levels) - 1
        made = rows.select("key", "text").join(extend, "key").mapInArrow(next_level(level, (0, 1) if top else (0,)), f"h long, {'g long, ' if top else ''}at int, n long, key long")
        seen = work.table(f"level{level}", made)
        work.drop(f"alive{level}")
        if not top and seen.isEmpty():
            seen = spark.createDataFrame([], "h long, g long, at int, n long, key long")
            break
    longer = seen
    whole = work.table("whole", longer.groupBy("h", "g").agg(F.sum("n").alias("n")).where("n > 1").select("h", "g"))
    hits = longer.where("n = 1").join(whole, ["h", "g"], "left_semi").groupBy("key").agg(F.collect_list("at").alias("starts"))
    told = work.table("told", hits.join(copies.select("key", "copies"), "key", "full"))
    work.drop(f"level{len(levels) - 1}", "groups", "copies", "whole")

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                turn = np.zeros(len(words) + 1, np.int32)
                start, owner = window_starts(words.first, window)
                copied = part.column("copies").fill_null(0).to_numpy(zero_copy_only=False) > 1
                start = start[copied[owner]]
                found = part.column("starts").fill_null(pa.scalar([], part.column("starts").type))
                owners = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
                start = np.unique(np.concatenate((start, found.flatten().to_numpy(zero_copy_only=False) + words.first[:-1][owners])).astype(np.int64))
                np.add.at(turn, start, 1)
                np.add.at(turn, start + window, -1)
                gone = np.cumsum(turn)[:-1] > 0
                data = words.data.copy()
                data[words.end] = 32  # each word and the byte after it make a kept stretch
                begin, end = words.begin[~gone], words.end[~gone]
                edge = np.zeros(len(data) + 1, np.int8)
                edge[begin] += 1
                edge[end + 1] -= 1
                kept = data[np.cumsum(edge[:-1]) > 0].tobytes()
                size = np.concatenate(([0], np.cumsum(end + 1 - begin)))
                many = np.concatenate(([0], np.cumsum(~gone)))[words.first]
                cut = size[many].tolist()
                texts = [kept[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                n, left = np.diff(words.first), np.diff(many)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(n - left), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    asked = rows.join(told, "key", "left").select("doc_id", "text", "copies", "starts")
    return asked.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
