"""Exact n-gram Jaccard self-join by a token-group matrix.

Documents with equal shingle sets are one representative. Representatives are partitioned into groups of likely
similar ones: those with the same one token, their least uncommon one or, if most of their tokens are common, the most
common one that isn't far more common than the rest. The matrix is kept sparse, as the prefix tokens of each group:

* inside a group, a document's overlap with the union of what other members hold bounds every overlap; members below
  the bound are out, the rest is compared (see `search`);
* between groups, a query document's extended prefix is held against the prefix union of every group: in a global
  order, common tokens last, a document's first (1 - t) n + l tokens share at least l tokens with those of every
  document it links to. Only groups that reach l, with sizes that can link, are opened, for the queries that reach it
  from either side, and only where links found before haven't joined all of them.

What is opened goes to tasks of a bounded number of tokens. There no pairs are listed: a document's overlaps are counted at
once, and nobody is compared with others of the component it is in, so a hot group costs about its size and a group
too large for a task is cut so that only documents outside its largest component are sent to several tasks.

Which groups are formed and which tokens count as common changes the work, never the result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace, ship
from .common import Words, lean, mix, pieces, signed, window_hashes, window_starts
from .components import components

_LOW = -(1 << 63)
#: Common tokens: in LEAST documents or more; at most MOST_COMMON of them, the most common ones, are broadcast (12 MB).
LEAST, MOST_COMMON = 12, 1_000_000
#: Tokens below this are counted in all documents: a prefix takes the lowest uncommon third. Tokens above it are counted in
#: the documents whose prefixes reach them.
COUNTED = -(1 << 63) + int(0.45 * (1 << 64))
#: Tokens that one task compares (a single document may have more); rows broadcast to a join with texts, which is shuffled beyond.
BLOCK, BROADCAST_ROWS = 500_000, 250_000
#: Documents of a task from which on overlaps are counted one document at a time instead of by pairs.
MANY = 24


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, one text after the other; where each begins.

    Words are lower-cased in A-Z; a text with fewer than `size` words has its whole sequence as its only shingle.
    """
    words = Words(texts, lower=True)
    h = words.hashes()
    start, owner = window_starts(words.first, size)
    tok = window_hashes(h, start, size)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        tok = np.concatenate((tok, window_hashes(h, words.first[:-1][short], n[short])))
        owner = np.concatenate((owner, short))
    tok = signed(tok)
    order = np.argsort(tok)
    order = order[np.argsort(owner[order], kind="stable")]
    tok, owner = tok[order], owner[order]
    fresh = np.ones(len(tok), bool)
    fresh[1:] = (tok[1:] != tok[:-1]) | (owner[1:] != owner[:-1])
    tok, owner = tok[fresh], owner[fresh]
    return tok, np.searchsorted(owner, np.arange(len(n) + 1))


def least_shared(n: np.ndarray) -> np.ndarray:
    """The l of a document's extended prefix."""
    return np.maximum(1, n // 12)


class Common:
    """The common tokens and how often each was seen."""

    def __init__(self, token: np.ndarray, count: np.ndarray):
        order = np.argsort(token)
        self.token, self.count = token[order], count[order]

    def weights(self, tok: np.ndarray) -> np.ndarray:
        """0 for a token that isn't common."""
        if not len(self.token):
            return np.zeros(len(tok), np.int64)
        at = np.minimum(np.searchsorted(self.token, tok), len(self.token) - 1)
        return np.where(self.token[at] == tok, np.minimum(self.count[at], 1 << 20), 0)

    def places(self, tok: np.ndarray) -> np.ndarray:
        """The global order, ties by token: counted uncommon tokens, other uncommon ones, then common ones by count."""
        weight = self.weights(tok)
        return np.where(weight > 0, weight + 1, (tok >= COUNTED).astype(np.int64))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - -(-percent * n // 100) + least_shared(n))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))
    return total[first[1:]] - total[first[:-1]]


def groups(tok: np.ndarray, first: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each text its group (0 for empty sets).

    Where less than half of the counted tokens are common: the least uncommon token. Else the text is one of many
    alike, and the most common token that its likes share (not over four times the median count, as passages from
    elsewhere are) is the same in nearly all of them.
    """
    n = np.diff(first)
    out = np.zeros(len(n), np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    counted = tok < COUNTED
    rare, often = (_sums((counted & x).astype(np.int64), first) for x in (weight == 0, weight > 0))
    out[full] = np.minimum.reduceat(np.where(weight == 0, tok, np.iinfo(np.int64).max), first[:-1][full])
    for i in full[often[full] > rare[full]].tolist():
        w, own = weight[first[i] : first[i + 1]], tok[first[i] : first[i + 1]]
        w = np.where(w <= 4 * np.median(w[w > 0]), w, 0)
        out[i] = own[np.argmax(w)]
    return out


def _need(n: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of these sizes that link."""
    return -(-percent * (n + other) // (100 + percent))


def _alive(entry_doc: np.ndarray, entry_run: np.ndarray, n: np.ndarray, task: np.ndarray, percent: int) -> np.ndarray:
    """Entries (document, run of one token in one task) left when documents go that can't link with any of their task.

    A document's overlap with the union of the others' tokens bounds its overlap with each; what goes shrinks the
    union for the rest, so a few rounds follow each other.
    """
    least = np.full(int(task[-1]) + 1, np.iinfo(np.int64).max) if len(task) else np.zeros(0, np.int64)
    np.minimum.at(least, task, n)
    need = _need(n, np.maximum(-(-percent * n // 100), least[task]), percent)
    kept = np.arange(len(entry_doc))
    for _ in range(4):
        width = np.bincount(entry_run[kept])
        shared = kept[width[entry_run[kept]] > 1]
        live = np.bincount(entry_doc[shared], minlength=len(n)) >= need
        left = shared[live[entry_doc[shared]]]
        if len(left) == len(kept):
            break
        kept = left
    return kept


def _by_pairs(doc: np.ndarray, run: np.ndarray, n: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked documents of entries sorted by run, of which each has few."""
    found = [np.zeros(0, np.int64)]
    k = 1
    while True:
        i = np.flatnonzero(run[k:] == run[:-k]) if k < len(run) else np.zeros(0, np.int64)
        if not len(i):
            break
        x, y = doc[i], doc[i + k]
        other = label[x] != label[y]
        found.append(np.minimum(x, y)[other] * len(n) + np.maximum(x, y)[other])
        k += 1
    pair, shared = np.unique(np.concatenate(found), return_counts=True)
    x, y = pair // len(n), pair % len(n)
    ok = 100 * shared >= percent * (n[x] + n[y] - shared)
    return x[ok], y[ok]


def _by_documents(doc: np.ndarray, run: np.ndarray, n: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For the entries of one task, sorted by run: documents and the label of one they are joined with.

    One document after the other is compared with all, until every document that wasn't is in one component.
    """
    own, local = np.unique(doc, return_inverse=True)
    size, first_label = n[own], label[own]
    _, part = np.unique(first_label, return_inverse=True)
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    width = np.diff(np.append(starts, len(run)))
    which = np.repeat(np.arange(len(starts)), width)
    order = np.argsort(local, kind="stable")
    of_doc = np.searchsorted(local[order], np.arange(len(own) + 1))
    waiting = np.ones(len(own), bool)
    while True:
        outside = np.flatnonzero(waiting & (part != np.bincount(part).argmax()))
        if not len(outside):
            break
        x = outside[0]
        waiting[x] = False
        runs = which[order[of_doc[x] : of_doc[x + 1]]]
        w = width[runs]
        at = np.repeat(starts[runs] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        shared = np.bincount(local[at], minlength=len(own))
        near = 100 * shared >= percent * (size + size[x] - shared)
        near[x] = True
        joined = np.unique(part[near])
        if len(joined) > 1:
            part[np.isin(part, joined)] = joined[0]
    least = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(least, part, first_label)
    moved = first_label != least[part]
    return first_label[moved], least[part][moved]


def links(texts: pa.Array, task: np.ndarray, label: np.ndarray, percent: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of labels that links inside the tasks join: enough of them that every link is inside one component. Rows of a task stand together."""
    tok, first = shingle_sets(texts, size)
    n = np.diff(first)
    _, task = np.unique(task, return_inverse=True)
    by_task = np.argsort(task, kind="stable")
    rank = np.empty(len(task), np.int64)
    rank[by_task] = np.arange(len(task))
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((tok, task[owner]))
    doc = owner[order]
    own, where = tok[order], task[doc]
    fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (where[1:] != where[:-1]))) if len(own) else np.zeros(0, bool)
    run = np.cumsum(fresh) - 1
    task_order = task[by_task]
    kept = _alive(rank[doc], run, n[by_task], task_order, percent) if len(doc) else np.zeros(0, np.int64)
    doc, run = doc[kept], run[kept]
    where = task[doc]
    docs_of = np.zeros(int(task.max()) + 1 if len(task) else 0, np.int64)
    alive = np.unique(doc)
    np.add.at(docs_of, task[alive], 1)
    few = docs_of[where] <= MANY
    x, y = _by_pairs(doc[few], run[few], n, label, percent)
    out = [(np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))]
    many_doc, many_run, where = doc[~few], run[~few], where[~few]
    cut = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
    for a, b in itertools.pairwise(cut if len(where) else []):
        out.append(_by_documents(many_doc[a:b], many_run[a:b], n, label, percent))
    a, b = (np.concatenate([o[i] for o in out]) for i in (0, 1))
    both = np.unique(np.column_stack((a, b)), axis=0)
    return both[:, 0], both[:, 1]


def search(tasks: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Edges (a, b) between labels, for rows (task, key, label); texts: (key, text). The texts of a task go to one place."""
    n = tasks.count()
    found = texts.join(F.broadcast(tasks) if n <= BROADCAST_ROWS else tasks, "key")
    dealt = found.select("task", "label", "text").repartition("task").sortWithinPartitions("task")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: pa.Table) -> pa.RecordBatch:
            a, b = links(rows.column("text").combine_chunks(), rows.column("task").to_numpy(), rows.column("label").to_numpy(), percent, size)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            for part in pieces(batch, "text"):
                held.append(part)
                weight += part.column("text").nbytes
                if weight < 1 << 20:
                    continue
                rows = pa.Table.from_batches(held)
                task = rows.column("task").to_numpy()
                cut = int(np.searchsorted(task, task[-1]))  # the last task may go on
                if cut:
                    yield judged(rows.slice(0, cut))
                    rows = rows.slice(cut).combine_chunks()
                    held = rows.to_batches()
                weight = sum(b.column("text").nbytes for b in held) if cut else 0
        if held:
            yield judged(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long")


def _long(*cols) -> Column:
    return F.xxhash64(*cols)


def opened(units: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Tasks (task, key, label) in which all pairs of different labels of a unit meet, of rows (unit, key, label, n).

    A unit of at most BLOCK tokens is one task. Of a larger one the documents outside its largest label are queries:
    blocks of queries meet all blocks.
    """
    whole = units.groupBy("unit", "label").agg(F.sum("n").alias("n"))
    whole = whole.groupBy("unit").agg(F.sum("n").alias("total"), F.max_by("label", F.struct("n", "label")).alias("home"), F.max("n").alias("at_home"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    rows = units.join(whole, "unit")
    small = rows.where(F.col("total") <= BLOCK).select(F.col("unit").alias("task"), "key", "label")
    if whole.where(F.col("total") > BLOCK).isEmpty():
        return work.table(name, small)
    large = rows.where(F.col("total") > BLOCK)
    blocks = lambda c: F.ceil(c / BLOCK).cast("long")
    queries, homes = blocks(F.col("total") - F.col("at_home")), blocks(F.col("at_home"))
    own = F.pmod(F.xxhash64("key"), F.when(F.col("label") == F.col("home"), homes).otherwise(queries))
    large = large.select("unit", "key", "label", (F.col("label") == F.col("home")).alias("h"), own.alias("own"), queries.alias("q"), homes.alias("hs"))
    home = large.where("h").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1))).select(_long("unit", F.lit("h"), "own", "other").alias("task"), "key", "label")
    ask = large.where("not h")
    to_home = ask.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hs") - 1))).select(_long("unit", F.lit("h"), "other", "own").alias("task"), "key", "label")
    among = ask.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1))).select(_long("unit", F.lit("q"), F.least("own", "other"), F.greatest("own", "other")).alias("task"), "key", "label")
    return work.table(name, small.unionByName(home).unionByName(to_home).unionByName(among))


def _common_tokens(rows: DataFrame, work: Workspace, name: str) -> Common:
    """Of rows (tok, n): tokens with LEAST or more in all, the MOST_COMMON of them."""
    found = work.table(name, rows.groupBy("tok").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))
    taken = found if found.count() <= MOST_COMMON else found.orderBy(F.desc("n"), "tok").limit(MOST_COMMON)
    held = taken.toArrow()
    work.drop(name)
    return Common(held.column("tok").to_numpy(), held.column("n").to_numpy())


def _low_counts(rows: DataFrame, size: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                tok, _ = shingle_sets(part.column("text"), size)
                own, n = np.unique(tok[tok < COUNTED], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype(np.int32))], names=["tok", "n"])

    return rows.select("text").mapInArrow(run, "tok long, n int")


def _described(rows: DataFrame, common, percent: int, size: int) -> DataFrame:
    """Per document its set's size and 128-bit hash, its group, and the uncounted tokens of those whose prefix reaches them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                tok, first = shingle_sets(part.column("text"), size)
                weight, n = common.value.weights(tok), np.diff(first)
                sums = [signed(_sums(mix(tok.view(np.uint64) + np.uint64(k)), first)) for k in (1, 2)]
                plain = _sums(((tok < COUNTED) & (weight == 0)).astype(np.int64), first)
                beyond = (tok >= COUNTED) & np.repeat(plain < prefix_length(n, percent), n)
                high = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(_sums(beyond.astype(np.int64), first)))).astype(np.int32)), pa.array(tok[beyond]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n), pa.array(groups(tok, first, weight)), *map(pa.array, sums), high], names=["doc_id", "key", "n", "gid", "a", "b", "high"])

    return rows.mapInArrow(run, "doc_id long, key long, n long, gid long, a long, b long, high array<long>")


def _prefixes(rows: DataFrame, common, percent: int, size: int) -> DataFrame:
    """(tok, key) for the extended prefix of every document; equal sets in one partition give theirs once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                tok, first = shingle_sets(part.column("text"), size)
                n = np.diff(first)
                sums = [_sums(mix(tok.view(np.uint64) + np.uint64(k)), first).tolist() for k in (1, 2)]
                fresh = np.ones(len(n), bool)
                for i, code in enumerate(zip(*sums, strict=True)):
                    fresh[i] = code not in seen
                    seen.add(code)
                if len(seen) > 500_000:
                    seen.clear()
                owner = np.repeat(np.arange(len(n)), n)
                order = np.argsort(owner << 22 | common.value.places(tok), kind="stable")
                tok = tok[order]
                keep = (np.arange(len(tok)) - first[:-1][owner] < prefix_length(n, percent)[owner]) & fresh[owner]
                yield pa.RecordBatch.from_arrays([pa.array(tok[keep]), part.column("key").take(pa.array(owner[keep]))], names=["tok", "key"])

    return rows.select("key", "text").mapInArrow(run, "tok long, key long")


def _between(shared: DataFrame, reps: DataFrame, labels: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """Units (unit, key, label, n): the documents of two groups that reach the bound of the other, of rows (tok, key)."""
    mine = shared.join(reps.select(F.col("rep").alias("key"), "gid", "n"), "key").dropDuplicates(["tok", "key"])
    matrix = mine.groupBy("tok", "gid").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    several = matrix.groupBy("tok").agg(F.min("gid").alias("g0"), F.max("gid").alias("g1")).where("g0 <> g1").select("tok")
    mine = work.table("mine", mine.join(several, "tok", "left_semi"))
    matrix = mine.groupBy("tok", "gid").agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumnRenamed("gid", "other")
    fits = (F.col("gid") != F.col("other")) & (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least"))
    met = mine.join(matrix, "tok").where(fits).groupBy("key", "gid", "n", "other").agg(F.count(F.lit(1)).alias("shared"))
    bound = F.greatest(F.lit(1), F.floor(F.ceil(percent * F.col("n") / 100) / 12))
    sides = met.where(F.col("shared") >= bound).select(F.least("gid", "other").alias("g1"), F.greatest("gid", "other").alias("g2"), (F.col("gid") < F.col("other")).alias("low"), "key", "n")
    sides = work.table("sides", sides.join(labels.withColumnRenamed("rep", "key"), "key").select("g1", "g2", "low", "key", "n", "label"))
    # A pair of groups is opened if both sides have queries and these aren't all joined.
    both = sides.groupBy("g1", "g2").agg(F.min("low").alias("x"), F.max("low").alias("y"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("x <> y and l0 <> l1").select("g1", "g2")
    return work.table("between", sides.join(both, ["g1", "g2"]).select(_long("g1", "g2").alias("unit"), "key", "label", "n"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = 5) -> DataFrame:
    """Columns doc_id, n_shingles, component_id (long): one row per row of docs.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct `size`-word shingles
    (A-Z lower-cased; words `[^\\x20\\x09-\\x0D]+`; fewer words: the whole sequence is the one shingle). component_id is
    the smallest doc_id reachable by links, itself included. Null and empty texts have empty sets and link with
    nothing, so they keep their own id. Rows with equal ids are documents of their own; null ids don't count as
    smallest (a component of null ids only has null). Very long texts are taken whole, an empty table gives no rows,
    other columns are ignored. percent is 1 to 100.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "jaccard")
    base = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), base.alias("key"))
    unique = rows.groupBy("key").count().where("count > 1").isEmpty()
    if not unique:  # rows are told apart by their place in a copy
        rows = work.table("rows", rows.withColumn("key", F.monotonically_increasing_id()))

    share = spark.sparkContext.broadcast
    low = _common_tokens(_low_counts(rows, size), work, "low")
    shared_low = share(low)
    described = work.table("docs", _described(rows, shared_low, percent, size))
    high = _common_tokens(described.select(F.explode("high").alias("tok"), F.lit(1).alias("n")), work, "high")
    common = share(Common(np.concatenate((low.token, high.token)), np.concatenate((low.count, high.count))))
    reps = work.table("reps", described.where("n > 0").groupBy("a", "b").agg(F.min("key").alias("rep"), F.min("gid").alias("gid"), F.min("n").alias("n")))
    texts = rows.select("key", "text")

    # Inside groups; what a task can't hold is first searched block by block.
    many = reps.groupBy("gid").agg(F.count(F.lit(1)).alias("reps"), F.sum("n").alias("total")).where("reps > 1")
    member = reps.join(many, "gid").select(F.col("gid").alias("unit"), F.col("rep").alias("key"), F.col("rep").alias("label"), "n", "total")
    tasks = work.table("inside", member.select(_long("unit", F.pmod(F.xxhash64("key"), F.ceil(F.col("total") / BLOCK))).alias("task"), "key", "label"))
    edges = work.table("edges-inside", search(tasks, texts, percent, size))

    def labelled(edges: DataFrame, name: str) -> DataFrame:
        found = components(edges, work, name).withColumnRenamed("node", "rep")
        return work.table(f"labels-{name}", reps.select("rep").join(found, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label")))

    labels = labelled(edges, "inside")
    if not many.where(F.col("total") > BLOCK).isEmpty():
        large = member.where(F.col("total") > BLOCK).select("unit", "key", "n").join(labels.withColumnRenamed("rep", "key"), "key")
        more = search(opened(large, work, "large"), texts, percent, size)
        edges = work.table("edges-large", edges.unionByName(more))
        labels = labelled(edges, "large")

    # Between groups.
    tokens = _prefixes(rows, common, percent, size)
    shared = tokens.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("tok"))).where("__n > 1").select("tok", "key")
    shared = work.table("shared", shared)
    shared = shared.join(described.select("key", "a", "b"), "key").join(reps.select("a", "b", "rep"), ["a", "b"]).select("tok", F.col("rep").alias("key"))
    units = _between(shared, reps, labels, percent, work)
    found = search(opened(units, work, "pairs"), texts, percent, size)
    edges = work.table("edges", edges.unionByName(found))
    labels = labelled(edges, "all")
    work.drop("inside", "edges-inside", "shared", "mine", "sides", "between", "pairs")

    classes = reps.join(labels, "rep").select("a", "b", F.col("label").alias("component"))
    out = described.join(classes, ["a", "b"], "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))
    if unique and rows.where("doc_id is null").isEmpty():
        return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    names = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return out.join(names, "component").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
