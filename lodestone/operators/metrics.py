"""Metric registries, limits and inventory as aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(rows: DataFrame, *by: str, value: str = "value", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """count, total, mean, least, most and last value of each metric."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.max_by(value, F.struct(ts, tie)).alias("last"))


def sliding_limit(rows: DataFrame, by: str, ts: str, seconds: int, most: int) -> DataFrame:
    """`seen` events of the same key in the trailing window (this one included) and whether this one is `allowed`."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return rows.withColumn("seen", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("seen") <= most)


def token_bucket(rows: DataFrame, by: str, ts: str, rate: float, capacity: float, tie: str = "event_id") -> DataFrame:
    """Per key the accepted and refused events of a bucket that refills at `rate` a second.

    Events are sorted by key and time and go through one pass; a key's state is two numbers, so a hot key needs no
    memory of its own.
    """
    at = (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t")
    dealt = rows.select(F.col(by), at, F.col(tie)).repartition(by).sortWithinPartitions(by, "t", tie)
    kind = dict(dealt.dtypes)[by]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last, ok, n = None, capacity, 0.0, 0, 0
        done: list[tuple] = []
        for frame in frames:
            for k, t in zip(frame[by].tolist(), frame["t"].tolist(), strict=True):
                if n == 0 or k != key:
                    if n:
                        done.append((key, ok, n, n - ok))
                    key, tokens, last, ok, n = k, capacity, t, 0, 0
                tokens, last, n = min(capacity, tokens + (t - last) * rate), t, n + 1
                if tokens >= 1:
                    tokens, ok = tokens - 1, ok + 1
            yield pd.DataFrame(done, columns=[by, "accepted", "events", "refused"])
            done.clear()
        if n:
            yield pd.DataFrame([(key, ok, n, n - ok)], columns=[by, "accepted", "events", "refused"])

    return dealt.mapInPandas(run, f"{by} {kind}, accepted long, events long, refused long")


def chunk_stats(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    n = F.length("content")
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.avg(n).alias("mean_chars"), F.min(n).alias("least_chars"), F.max(n).alias("most_chars"))


def inventory(chunks: DataFrame, filename: Column, source_file: Column, source: Column) -> DataFrame:
    """Chunks of each file: its name, else the stored name without its 8-character hash, else the last part of the source."""
    name = F.coalesce(filename, F.regexp_replace(source_file, r"_[0-9a-f]{8}$", ""), F.element_at(F.split(source, "/"), -1))
    return chunks.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("chunks"))
