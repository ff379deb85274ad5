"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to cells of a small grid; rows are ordered by the cell's index on the Hilbert curve
(then by id) and the order is cut into runs. Neighbours on the curve are neighbours in every dimension, so a shard
covers a compact box and a file's least and greatest values prune it for filters on any of the dimensions.
Plain DataFrame operations throughout; only metadata moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace

BITS = 4


def hilbert_index(cell: tuple[int, ...], bits: int = BITS) -> int:
    """The place of a cell on the Hilbert curve over a grid with 2**bits steps a side (any number of dimensions).

    The transpose form: undo the excess rotations from the top bit down, Gray-encode, interleave the bits.
    """
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def string_limits(rows: DataFrame, column: str, steps: int, work: Workspace) -> list[str]:
    """The steps - 1 quantiles of a string column in byte order, by whole values, exact.

    Distinct values are counted, cut into ranges and summed inside each; totals of the ranges (one row a partition) and
    the quantiles reach the driver.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = rows.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(parts, "v")
    counted = work.table(f"values_{column}", counted.withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in counted.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    total, before = 0, []
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(total).cast("long")]
        total += sizes[part]
    if not total:
        return []
    upto = F.create_map(*before)[F.col("part")] + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    found = counted.withColumn("upto", upto).agg(*(F.min(F.when(F.col("upto") * steps >= i * total, F.col("v"))).alias(str(i)) for i in range(1, steps))).first()
    work.drop(f"values_{column}")
    return list(found)


def hilbert_order(docs: DataFrame, dims: dict[str, Column], bits: int = BITS) -> DataFrame:
    """Adds column `hilbert`: the curve index of the row's cell.

    Each dimension is quantised into at most 2**bits steps: numbers (null counts as 0) by their approximate quantiles,
    strings (null counts as empty) by those of the whole values in byte order,
    so a hot value takes one step and the rest still spreads. 2 to 3 dimensions keep the lookup table small.
    """
    steps = 1 << bits
    grid = [i / steps for i in range(1, steps)]
    names = list(dims)
    strings = [n for n, (_, kind) in zip(names, docs.select(*dims.values()).dtypes, strict=True) if kind == "string"]
    with_dims = docs.withColumns({f"__dim_{n}": F.coalesce(dims[n], F.lit("")) if n in strings else F.coalesce(dims[n].cast("long"), F.lit(0)) for n in names})
    numbers = [n for n in names if n not in strings]
    found = with_dims.agg(F.count(F.lit(1)), *(F.percentile_approx(f"__dim_{n}", F.lit(grid), F.lit(10_000)).alias(n) for n in numbers)).first().asDict()
    work = Workspace(docs.sparkSession, "limits")
    found |= {n: string_limits(with_dims, f"__dim_{n}", steps, work) for n in strings}
    cell = F.lit(0)
    for n in names:
        step = F.lit(0)
        for limit in sorted(set(found[n] or [])):
            step = step + (F.col(f"__dim_{n}") > F.lit(limit)).cast("int")
        cell = cell * steps + step
    table = []
    for i in range(steps ** len(names)):
        coords = []
        for _ in names:
            i, r = divmod(i, steps)
            coords.append(r)
        table.append(hilbert_index(tuple(reversed(coords)), bits))
    lookup = "array(" + ",".join(map(str, table)) + ")"
    out = with_dims.withColumn("__cell", cell).withColumn("hilbert", F.expr(f"element_at({lookup}, __cell + 1)"))
    return out.drop("__cell", *(f"__dim_{n}" for n in names))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("source", "lang"), shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert.

    Law `rows`: the order by (hilbert, text checksum, id, size) is cut into `shards` runs whose row counts differ by
    one at most, whatever keys or copies are hot; slot counts from 0 inside a shard. Dimensions: UTF-8 size and the
    columns in `by` (missing ones are left out). Null text: size 1 and the checksum of nothing; null ids stay null.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    dims = {c: F.col(c).cast("string") for c in by if c in docs.columns}
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *(d.alias(f"by_{c}") for c, d in dims.items()),
    )
    work = Workspace(spark, "shards")
    rows = work.table("metadata", rows)
    ordered = hilbert_order(rows, {"size": F.col("size")} | {f"by_{c}": F.col(f"by_{c}") for c in dims})
    keys = ["hilbert", "text_crc32", "doc_id", "size"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = ordered.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = runs.withColumn("__at", F.monotonically_increasing_id())  # partition in the upper bits, place in it in the lower 33
    placed = work.table("ordered", placed.select("doc_id", "size", "text_crc32", "hilbert", F.shiftright("__at", 33).cast("int").alias("part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("at")))
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    total, before = sum(counts.values()), {}
    done = 0
    for p in sorted(counts):
        before[p] = done
        done += counts[p]
    offsets = spark.createDataFrame([(p, n) for p, n in before.items()], "part int, before long")
    rank = F.col("before") + F.col("at")
    ranked = placed.join(F.broadcast(offsets), "part").withColumn("rank", rank)  # at most one row a partition
    # The first rank of a shard s is the least r with r * shards >= s * n; integers throughout, so cuts are exact.
    shard = F.expr(f"cast((rank * {shards}) div {max(total, 1)} as int)")
    first = F.expr(f"(shard * cast({max(total, 1)} as long) + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write documents as one folder per shard, each file ordered along the curve; ids must be unique."""
    where = placed.select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    joined = docs.join(where, F.col(id_col) == F.col("__id")).drop("__id")
    joined.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").withColumnRenamed("__shard", "shard").drop("__slot").write.partitionBy("shard").parquet(path)
