"""Chunkers: documents in, one row per chunk out (doc_id, position, content and what the strategy adds).

Greedy strategies are folds over a document's own array of sentences or offsets, so a document is one row until it
is exploded and nothing is shuffled. Ids are hashes of document, strategy and position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vec


def _explode(docs: DataFrame, id_col: str, chunks: Column, strategy: str) -> DataFrame:
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunks).alias("position", "content"))
    return out.withColumn("chunk_id", tx.content_key(F.col("doc_id").cast("string"), F.lit(strategy), F.col("position").cast("string")))


def pack_spans(lengths: Column, size: int = 512, overlap: int = 1) -> Column:
    """Spans (first, last exclusive) of greedy packs over an array of lengths: a pack is full when the next would exceed
    `size`; the next begins with the last `overlap` of it. A fold over numbers: only full packs grow the result."""
    zero = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(0).alias("from"), F.lit(0).alias("i"), F.lit(0).alias("len"), (F.array().cast("array<int>") if overlap > 1 else F.lit(0)).alias("tail"))

    def step(acc: Column, n: Column) -> Column:
        i, begin, tail = acc["i"], acc["from"], acc["tail"]  # tail: the pack's last `overlap` lengths, or its last one
        full = (acc["len"] + n > size) & (i > begin)
        if overlap > 1:
            last = F.concat(tail, F.array(n))
            again, kept, tail = F.size(tail), F.aggregate(tail, F.lit(0), lambda s, x: s + x), F.slice(last, F.greatest(F.size(last) - overlap, F.lit(0)) + 1, overlap)
        else:
            again, kept, tail = F.lit(overlap), (tail if overlap else F.lit(0)), n
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.struct(begin.alias("a"), i.alias("b"))))).otherwise(acc["done"]).alias("done"),
            F.when(full, i - again).otherwise(begin).alias("from"),
            (i + 1).alias("i"),
            (F.when(full, kept).otherwise(acc["len"]) + n).alias("len"),
            tail.alias("tail"),
        )

    return F.aggregate(lengths, zero, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["from"].alias("a"), acc["i"].alias("b")))))


def _joined(spans: Column, sentences: Column) -> Column:
    return F.transform(spans, lambda p: F.array_join(F.slice(sentences, p["a"] + 1, p["b"] - p["a"]), " "))


def sentence_packs(sentences: Column, size: int = 512, overlap: int = 1, least: int = 100) -> Column:
    """Greedy packs of sentences (separators not counted); a last pack shorter than `least` is dropped. Give a column, not
    an expression: the sentences are read several times."""
    packs = _joined(pack_spans(F.transform(sentences, F.length), size, overlap), sentences)
    n = F.size(packs)
    return F.concat(F.slice(packs, 1, n - 1), F.filter(F.slice(packs, n, 1), lambda c: F.length(c) >= least))


def _exploded(rows: DataFrame, keep: list[str], size: int, overlap: int, least: int) -> DataFrame:
    """keep, position and content of the packs of rows with an array column __s; what is exploded are the packs alone."""
    rows = rows.withColumn("__p", pack_spans(F.transform("__s", F.length), size, overlap))
    out = rows.select(*keep, F.size("__p").alias("__n"), F.posexplode(_joined(F.col("__p"), F.col("__s"))).alias("position", "content"))
    return out.where((F.length("content") >= least) | (F.col("position") < F.col("__n") - 1)).drop("__n")


def sentence_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 1, least: int = 100) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), tx.sentences(F.col(text_col)).alias("__s"))
    out = _exploded(rows, ["doc_id"], size, overlap, least)
    return out.withColumn("chunk_id", tx.content_key(F.col("doc_id").cast("string"), F.lit("sentence"), F.col("position").cast("string")))


def fixed_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 50, reach: int | None = None) -> DataFrame:
    """Windows of `size` characters, each starting `size - overlap` after the last; stops at the end of the text.

    With `reach` a column context has the window and as many characters around it (late-chunking context), cut where the
    text is at hand.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap lies below size")
    n, step = F.length(text_col), size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t"), F.posexplode(starts).alias("position", "begin"))
    end = F.least(F.col("begin") + size, F.length("__t"))
    around = []
    if reach is not None:
        start = F.greatest(F.col("begin") - reach, F.lit(0))
        around = [F.substring(F.col("__t"), start + 1, end + reach - start).alias("context")]
    out = rows.select("doc_id", "position", "begin", end.alias("end"), F.substring(F.col("__t"), F.col("begin") + 1, F.lit(size)).alias("content"), *around)
    return out.withColumn("chunk_id", tx.content_key(F.col("doc_id").cast("string"), F.lit("fixed"), F.col("position").cast("string")))


def soft_cuts(text: str, size: int, overlap: int, separator: str = " ") -> list[tuple[int, int]]:
    """Windows that end at the last separator in their final fifth, if it has one."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            low = start + int(size * 0.8)
            at = text.rfind(separator, low, end)
            if at > low:
                end = at + 1
        out.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def split_recursively(text: str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", ". ", "! ", "? ", " ", ""), length: Callable[[str], int] = len) -> list[str]:
    """Pieces of at most `size`, in text order: split by the first separator, deeper where a piece is too long, then
    merged greedily; each merged piece begins with up to `overlap` of the one before."""

    def cut(part: str, level: int) -> Iterator[str]:
        if length(part) <= size:
            yield part
            return
        sep = separators[level] if level < len(separators) else ""
        if sep == "":
            step = max(1, size)
            yield from (part[i : i + step] for i in range(0, len(part), step))
            return
        bits = part.split(sep)
        for i, bit in enumerate(bits):
            piece = bit + (sep if i < len(bits) - 1 else "")
            if piece:
                yield from cut(piece, level + 1)

    out: list[str] = []
    current = ""
    for piece in cut(text, 0):
        if current and length(current) + length(piece) > size:
            out.append(current)
            current = current[max(0, len(current) - overlap) :] if overlap and length(piece) + overlap <= size else ""
        current += piece
    if current.strip():
        out.append(current)
    return [x.strip() for x in out if x.strip()]


def _python_chunks(docs: DataFrame, id_col: str, text_col: str, strategy: str, split: Callable[[str], list[str]]) -> DataFrame:
    """For true recursion only: Arrow batches, one pass, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, p, c) for i, t in zip(frame["doc_id"], frame["t"], strict=True) for p, c in enumerate(split(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "position", "content"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    out = rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, position int, content string")
    return out.withColumn("chunk_id", tx.content_key(F.col("doc_id").cast("string"), F.lit(strategy), F.col("position").cast("string")))


def soft_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    return _python_chunks(docs, id_col, text_col, "soft", lambda t: [t[a:b].strip() for a, b in soft_cuts(t, size, overlap) if t[a:b].strip()])


def recursive_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    return _python_chunks(docs, id_col, text_col, "recursive", lambda t: split_recursively(t, size, overlap))


def token_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 128, overlap: int = 0) -> DataFrame:
    """Recursive splitting by estimated tokens (1.3 a word)."""
    return _python_chunks(docs, id_col, text_col, "token", lambda t: split_recursively(t, size, overlap, length=lambda s: int(len(s.split()) * 1.3)))


def fallback_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """1500 characters, 150 shared, ends moved back to a sentence end in the last 150."""

    def split(t: str) -> list[str]:
        out, start = [], 0
        while start < len(t):
            end = min(start + 1500, len(t))
            if end < len(t):
                at = max(t.rfind(x, end - 150, end) for x in (". ", "! ", "? ", "\n"))
                end = at + 1 if at > start else end
            out.append(t[start:end].strip())
            if end >= len(t):
                break
            start = max(end - 150, start + 1)
        return [x for x in out if x]

    return _python_chunks(docs, id_col, text_col, "fallback", split)


def hierarchical_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, ...] = (2000, 512, 128), least: int = 20) -> DataFrame:
    """Sentence packs of falling size, each level cut out of the one above: level 0 is the largest. parent_id links them;
    every row keeps the real doc_id."""
    level = docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("string").alias("parent_id"), F.col(text_col).alias("content"))
    out = None
    for i, size in enumerate(sizes):
        cut = level.select("doc_id", F.coalesce("parent_id", F.lit("")).alias("up"), tx.sentences(F.col("content")).alias("__s"))
        rows = _exploded(cut, ["doc_id", "up"], size, 0, least)
        rows = rows.select("doc_id", F.lit(i).alias("level"), F.nullif("up", F.lit("")).alias("parent_id"), "position", "content", tx.content_key(F.col("doc_id").cast("string"), F.lit(f"level{i}"), F.col("up"), F.col("position").cast("string")).alias("chunk_id"))
        out = rows if out is None else out.unionByName(rows)
        level = rows.select("doc_id", F.col("chunk_id").alias("parent_id"), "content")
    return out


def parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Small to big: of ranked hits (query_id, chunk_id, rank) the distinct parents, ranked by their first child; a chunk without parent stands for itself."""
    up = hits.join(chunks.select("chunk_id", "parent_id"), "chunk_id").withColumn("parent", F.coalesce("parent_id", "chunk_id"))
    first = up.groupBy("query_id", F.col("parent").alias("chunk_id")).agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("children"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank", "chunk_id")))


def children(chunks: DataFrame) -> DataFrame:
    """(chunk_id, child_ids in order) of chunks that have any."""
    return chunks.where("parent_id is not null").groupBy(F.col("parent_id").alias("chunk_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("chunk_id").alias("c")))), lambda x: x["c"]).alias("child_ids"))


def context_window(ranked: DataFrame, chunks: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """Per query the chunks in rank order up to the first that would exceed four characters a token."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.join(chunks.select("chunk_id", "content"), "chunk_id").withColumn("total", F.sum(F.length("content")).over(w))
    return rows.withColumn("over", F.max((F.col("total") > 4 * max_tokens).cast("int")).over(w)).where("over = 0").drop("over")


def render_context(parent: Column, content: Column, details: Column) -> Column:
    block = lambda name, c: F.when(c.isNotNull() & (F.length(c) > 0), F.concat(F.lit(f"[{name}]\n"), c))
    return F.concat_ws("\n\n", block("Parent Context", parent), block("Content", content), block("Details", details))


def markdown_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """Sections under headings with their header path; sections under `least` characters are dropped.

    Headings of a document are folded into paths inside its own row; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.split(text_col, "\n").alias("__l"))
    mark = r"^(#{1,6})\s+(.+)$"
    marks = F.transform("__l", lambda x, i: F.struct(i.alias("at"), F.length(F.regexp_extract(x, mark, 1)).alias("depth"), F.trim(F.regexp_extract(x, mark, 2)).alias("title")))
    rows = rows.withColumn("__h", F.filter(marks, lambda h: h["depth"] > 0))
    none = F.array().cast("array<struct<depth:int,title:string>>")
    zero = F.struct(none.alias("stack"), F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("path"))).alias("out"))

    def step(acc: Column, h: Column) -> Column:
        stack = F.concat(F.filter(acc["stack"], lambda x: x["depth"] < h["depth"]), F.array(F.struct(h["depth"].alias("depth"), h["title"].alias("title"))))
        path = F.array_join(F.transform(stack, lambda x: x["title"]), " > ")
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(h["at"].alias("at"), path.alias("path")))).alias("out"))

    rows = rows.withColumn("__s", F.aggregate("__h", zero, step, lambda acc: acc["out"]))
    rows = rows.select("doc_id", "__l", "__s", F.posexplode("__s").alias("section", "s"))
    upto = F.coalesce(F.get("__s", F.col("section") + 1)["at"], F.size("__l"))
    body = F.trim(F.array_join(F.slice("__l", F.col("s.at") + 2, F.greatest(upto - F.col("s.at") - 1, F.lit(0))), "\n"))
    rows = rows.select("doc_id", "section", F.col("s.path").alias("header_path"), body.alias("content")).where(F.length("content") >= least)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("section")) - 1)


def breakpoints(similarity: Column, lengths: Column, threshold: Column, most: int = 1000, least: int = 100) -> Column:
    """Sentence numbers where a chunk begins: 0, and after each sentence whose similarity to the next is below the
    threshold or at which the running length (one more a sentence) exceeds `most`, unless it is below `least`. The
    running length restarts at a break."""
    # What the fold needs goes through its items and its state: a column named inside it would be worked out at every step.
    zero = F.struct(F.array(F.lit(0)).alias("at"), F.lit(0).alias("len"), F.lit(0).alias("i"), F.round(threshold, 12).alias("limit"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["len"] + x["n"] + 1
        stop = ((x["s"] < acc["limit"]) | (n > most)) & (n >= least)  # at 12 digits ties don't hang on the order of sums
        return F.struct(F.when(stop, F.concat(acc["at"], F.array(acc["i"] + 1))).otherwise(acc["at"]).alias("at"), F.when(stop, 0).otherwise(n).alias("len"), (acc["i"] + 1).alias("i"), acc["limit"].alias("limit"))

    items = F.zip_with(similarity, F.slice(lengths, 1, F.size(similarity)), lambda s, n: F.struct(F.round(s, 12).alias("s"), n.alias("n")))
    return F.aggregate(items, zero, step, lambda acc: acc["at"])


def smooth(values: Column, window: int = 3) -> Column:
    """Centred moving average clipped at the ends; unchanged if there are no more values than the window."""
    half = window // 2
    mean = F.transform(values, lambda v, i: vec._sum(F.slice(values, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, F.size(values) - 1) - F.greatest(i - half, F.lit(0)) + 1)) / (F.least(i + half, F.size(values) - 1) - F.greatest(i - half, F.lit(0)) + 1))
    return F.when(F.size(values) > window, mean).otherwise(values)


def adjacent(sentences: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence, similarity): each sentence's cosine (1e-8 added to the denominator) with the next one of its
    document, null for the last; rows (doc_id, pos, sentence, embedding)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = sentences.withColumn("__norm", vec.norm(F.col("embedding")))
    rows = rows.withColumn("__next", F.lead(F.struct("embedding", "__norm")).over(w))
    near = vec.dot(F.col("embedding"), F.col("__next.embedding")) / (F.col("__norm") * F.col("__next.__norm") + F.lit(1e-8))
    return rows.select("doc_id", "pos", "sentence", F.when(F.col("__next").isNotNull(), near).alias("similarity"))


def percentile_of(values: Column, percentile: float) -> Column:
    """The linearly interpolated percentile of an array; null for an empty one."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * (percentile / 100.0)
    low = F.floor(at).cast("int")
    first = F.get(ordered, low)
    return first + (at - low) * (F.coalesce(F.get(ordered, low + 1), first) - first)


def semantic_chunks(sentences: DataFrame, threshold: float | None = 0.5, percentile: float | None = None, most: int = 1000, least: int = 100) -> DataFrame:
    """Chunks of a table (doc_id, pos, sentence, embedding): breaks where neighbours differ.

    Similarities are smoothed over three; with `percentile` each document's own percentile of them is its threshold.
    Documents of up to two sentences are one chunk. Vectors are compared before documents are gathered: one shuffle by
    document, and only sentences and numbers are folded.
    """
    item = F.struct("pos", "sentence", "similarity")
    rows = adjacent(sentences).groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("__i"))
    rows = rows.select("doc_id", F.transform("__i", lambda x: x["sentence"]).alias("s"), F.transform(F.slice("__i", 1, F.greatest(F.size("__i") - 1, F.lit(0))), lambda x: x["similarity"]).alias("raw"))
    rows = rows.withColumn("sims", smooth(F.col("raw")))
    limit = F.lit(float(threshold)) if percentile is None else percentile_of(F.col("sims"), percentile)
    rows = rows.withColumn("limit", limit).withColumn("n", F.transform("s", F.length))
    rows = rows.withColumn("at", F.when(F.size("s") <= 2, F.array(F.lit(0))).otherwise(breakpoints(F.col("sims"), F.col("n"), F.col("limit"), most, least)))
    spans = F.zip_with("at", F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("s"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return rows.select("doc_id", F.posexplode(_joined(spans, F.col("s"))).alias("position", "content"))


def contextual(content: Column, header: Column) -> Column:
    return F.concat(F.lit("[Context: "), header, F.lit("]\n\n"), content)


def marked(text: Column, chunk: Column, reach: int = 200) -> Column:
    """A chunk in its surroundings, between [CHUNK] marks; the chunk alone if the text doesn't hold it."""
    at = F.position(chunk, text)
    start = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.concat(F.substring(text, start, at - start), F.lit("[CHUNK]"), chunk, F.lit("[/CHUNK]"), F.substring(text, at + F.length(chunk), F.lit(reach)))).otherwise(chunk)
