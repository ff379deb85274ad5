"""Structured Streaming forms: windowed counts, exact dedup, chat state, rate limits, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..sources.vector_table import VectorTable


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files that arrive in a folder; naive timestamps become instants so that watermarks apply."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def limited(events: DataFrame, rate: float, capacity: float, idle_ms: int | None = 3_600_000) -> DataFrame:
    """(user_id, accepted, refused) per micro-batch: a token bucket for each user that lives in state; a user who is
    idle that long is forgotten (the bucket is full again by then if that is capacity / rate or more). None: never, as a
    stream that is drained once needs, for timeouts keep it running."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        ok = n = 0
        rows = pd.concat(list(frames)).sort_values("ts")
        for t in rows["ts"].astype("int64") / 1e9:
            tokens = min(capacity, tokens + (max(0.0, t - last) * rate if last is not None else 0.0))
            last = max(t, last) if last is not None else t
            n += 1
            if tokens >= 1:
                tokens, ok = tokens - 1, ok + 1
        state.update((float(tokens), float(last)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "accepted": [ok], "refused": [n - ok]})

    seconds = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return seconds.groupBy("user_id").applyInPandasWithState(step, "user_id long, accepted long, refused long", "tokens double, last double", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def chat_history(turns: DataFrame, keep: int = 10, idle_ms: int | None = 86_400_000) -> DataFrame:
    """(conv_id, history) per micro-batch: the last `keep` messages of a conversation, from state that idle conversations lose (idle_ms None: never)."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn")
        history = (history + [f"{r.role}: {r.text}" for r in rows.itertuples()])[-keep:]
        state.update((history,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "history": [history]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, history array<string>", "history array<string>", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def ingest(docs: DataFrame, table: VectorTable, checkpoint: str, embed: Callable[[DataFrame, str, str], DataFrame], chunker: Callable[[DataFrame], DataFrame] = chunking.sentence_chunks):
    """Chunk, embed and upsert documents as they come. Chunks have ids of their own text's place, so a batch or a
    document that comes again replaces what it made before, and chunks that a shorter text no longer has go."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunker(batch)
        new = chunks.join(embed(chunks, "chunk_id", "content"), "chunk_id")
        if table.exists():
            gone = table.scan().join(batch.select("doc_id").distinct(), "doc_id", "left_semi").join(chunks.select("chunk_id"), "chunk_id", "left_anti")
            if not gone.isEmpty():
                table.delete(gone)
        table.upsert(new)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a memory table; for tests and small jobs."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
